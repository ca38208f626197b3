import random

import pytest

from wavespark.llm import licenses


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_every_template_wins_on_itself(name):
    text = "Prose before it.\n" + licenses.TEMPLATES[name].replace("<>", "2024 Jane Doe and others.") + "\nprose goes on and on"
    assert [r[1] for r in licenses.scan(text)] == [name]


def test_differences():
    words = licenses.TEMPLATES["MIT"].split()
    words[5] = "cost,"
    del words[20]
    wrapped = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
    ((_, name, _, share, found),) = licenses.scan(wrapped)
    assert name == "MIT" and share > 0.7 and found == ["+cost", "-of", "-the"]


@pytest.mark.parametrize("text", ["a license to kill", "Licensed under the Apache License, Version 1.1.", "copyright law is long and rights are reserved", "", "the MIT campus"])
def test_no_notice(text):
    assert list(licenses.scan(text)) == []


def test_several_in_a_text():
    text = "x\nReleased under the MIT License.\n" + "word " * 500 + "\nLicensed under CC BY-NC 4.0.\nLICENSED UNDER CC BY 4.0."
    found = list(licenses.scan(text))
    assert [r[1] for r in found] == ["MIT notice", "CC-BY-NC-4.0 notice", "CC-BY-4.0 notice"]
    assert all(text[r[0] :].lower().startswith(("released", "licensed")) for r in found)


def test_anywhere_in_a_line():
    """A notice lies behind, or begins before, the word that gives it away, however long its line is."""
    for before in (0, 150, 300, 5000):
        text = "word " * before + "Released under the MIT License." + " word" * 3000 + " a license to kill," + " word" * 250 + " " + licenses.TEMPLATES["GPL-3.0"].replace("\n", " ") + " word" * 300
        found = list(licenses.scan(text))
        assert [(r[0], r[1]) for r in found] == [(5 * before, "MIT notice"), (text.index("This program"), "GPL-3.0")]
    dense = "copyright law " * 1000 + "Licensed under CC BY-NC 4.0."
    assert [(r[0], r[1]) for r in licenses.scan(dense)] == [(14_000, "CC-BY-NC-4.0 notice")]


@pytest.mark.parametrize("names", [("MIT notice", "Apache-2.0 notice"), ("CC0-1.0 notice", "GPL-3.0", "MIT SPDX", "Apache-2.0", "MIT notice", "BSD-2-Clause", "CC-BY-4.0 notice")])
def test_several_in_a_line(names):
    for order in (names, names[::-1]):
        text = "Prose before. " + " ".join(licenses.TEMPLATES[k].replace("\n", " ") for k in order) + " And after."
        found = list(licenses.scan(text))
        assert [r[1] for r in found] == list(order) and [r[0] for r in found] == sorted(r[0] for r in found)


def test_recall_at_random_places():
    """Notices with a few changed words, anywhere in one-line prose: found at their places, and nothing else is."""
    rng = random.Random(5)
    prose = "the quick report of spring says that free public works need a fair share of time and of good software for all who read".split()
    names = [k for k in licenses.TEMPLATES if k != "Proprietary"]
    want = hits = extra = 0
    for _ in range(60):
        parts, there = [], []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choices(prose, k=rng.randrange(3, 400))
            name = rng.choice(names)
            own = licenses.TEMPLATES[name].split()
            for k in rng.sample(range(len(own)), len(own) // 30):
                if not licenses._needed((licenses.words(own[k]) or ["mit"])[0]):
                    own[k] = rng.choice(prose)
            there.append((len(" ".join(parts)) + 1, name))
            parts += own
        text = " ".join([*parts, *rng.choices(prose, k=30)])
        found = [(r[0], r[1]) for r in licenses.scan(text)]
        want += len(there)
        hits += sum(any(n == name and abs(at - a) <= 40 for a, n in found) for at, name in there)
        extra += len(found) - len(there)
    assert hits >= 0.99 * want and extra <= 0.01 * want, (hits, want, extra)


def test_alignment_is_least():
    """Against all spans of the block and a plain edit distance."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (0 if x == y else 2)))
        return row[-1]

    rng = random.Random(2)
    for _ in range(60):
        t = [rng.choice("abcd") for _ in range(rng.randrange(1, 7))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 9))]
        lo, hi, diff = licenses.align(t, b)
        best = min(distance(t, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert len(diff) == best == distance(t, b[lo:hi])


def test_awkward(awkward, nothing):
    assert licenses.find(awkward).count() == 0 and licenses.find(nothing).count() == 0
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "SPDX-License-Identifier: Apache-2.0"), (2, None)]
    found = licenses.find(awkward.sparkSession.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in found) == [(0, "Apache-2.0 SPDX"), (1, "MIT notice"), (1, "MIT notice")]


def test_same_as_lines(spark, data):
    """On the generated documents notices are whole lines."""
    notices = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0 notice", "Released under the MIT License.": "MIT notice", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 notice", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0 notice"}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted((r["doc_id"], notices[line]) for r in docs.collect() for line in (r["text"] or "").split("\n") if line in notices)
    assert want == sorted((r["doc_id"], r["license"]) for r in licenses.find(docs).collect())
