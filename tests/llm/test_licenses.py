import random

import numpy as np
import pyarrow as pa
import pytest

from corpuslens.llm.batches import PLAIN, Words
from corpuslens.llm.licenses import TEMPLATES, Index, align, find, scan
from tests.llm.conftest import filler


def whole_matrix(t, w, shift, band):
    """Score of the best local alignment within the band, over the full matrix."""
    low = -(10**9)
    h = [[0] * (len(w) + 1) for _ in range(len(t) + 1)]
    inside = lambda i, j: abs(j - i - shift) <= band
    best = 0
    for i in range(1, len(t) + 1):
        for j in range(1, len(w) + 1):
            if inside(i - 1, j - 1):
                up = h[i - 1][j] - 1 if i > 1 and inside(i - 2, j - 1) else low
                side = h[i][j - 1] - 1 if j > 1 and inside(i - 1, j - 2) else low
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if t[i - 1] == w[j - 1] else -1), up, side)
                best = max(best, h[i][j])
    return best


def test_alignment_is_the_best():
    rng = random.Random(3)
    for _ in range(200):
        t = [rng.randrange(4) for _ in range(rng.randint(3, 12))]
        w = [rng.randrange(4) for _ in range(rng.randint(1, 14))]
        shift, band = rng.randint(-2, 4), rng.randint(1, 4)
        pairs = align(np.array(t), np.array(w), shift, band)
        assert all(t[i] == w[j] and abs(j - i - shift) <= band for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        if pairs:
            left_out = sum(max(c - a, d - b) - 1 for (a, b), (c, d) in zip(pairs, pairs[1:]))
            assert 2 * len(pairs) - left_out <= whole_matrix(t, w, shift, band) <= 2 * len(pairs)
        else:
            assert whole_matrix(t, w, shift, band) == 0


def test_exact_edited_and_missing(docs):
    mit = TEMPLATES["mit"]
    edited = mit.split()
    edited[10:12] = ["whatever"]
    edited.insert(40, "extra words here")
    lead = " ".join(filler(1, 30))
    rows = [
        (1, f"{lead}\n{mit}\n{lead}"), (2, f"{lead} {' '.join(edited)}"), (3, lead), (4, None), (5, ""), (6, "é ü " + TEMPLATES["mit-notice"].upper()),
        (7, " ".join([TEMPLATES["mit-notice"]] * 50)), (8, " ".join(mit.split()[:30])), (9, "* " + mit.replace(" ", "\n * ")),
        (10, TEMPLATES["apache-2.0-notice"] + TEMPLATES["gpl-3.0-notice"]), (1, f"{lead}\n{mit}\n{lead}"), (None, mit),
    ]
    found = scan(docs(rows)).collect()
    assert len(found) == len(rows) and all(r.n_matches == len(r.matches) for r in found)
    by = {r.doc_id: [(m.license, m.coverage, m.start_byte, m.end_byte) for m in r.matches] for r in found}
    begin = len(lead) + 1
    assert by[1] == [("mit", 1.0, begin, begin + len(mit) - 1)]
    (name, coverage, start, _), = by[2]
    assert name == "mit" and 0.95 < coverage < 1 and start == begin
    assert [by[k] for k in (3, 4, 5, 8)] == [[], [], [], []]
    assert by[6] == [("mit-notice", 1.0, 6, 6 + len(TEMPLATES["mit-notice"]) - 1)]
    assert len(by[7]) == 50 and {m[0] for m in by[7]} == {"mit-notice"}
    assert [m[0] for m in by[9]] == ["mit"] and by[9][0][1] == 1.0
    assert [m[0] for m in by[10]] == ["apache-2.0-notice", "gpl-3.0-notice"]


def test_every_template_finds_itself_alone_of_its_length():
    index = Index(TEMPLATES)
    for name, text in TEMPLATES.items():
        (matches,) = find(index, Words(pa.array([text]), PLAIN))
        assert (name, 1.0) in {m[:2] for m in matches}
        assert {m[0] for m in matches} <= {name, "apache-2.0-notice"}


def test_empty_table_and_bad_template(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        Index({"x": "too short"})


def names(text):
    (matches,) = find(Index(TEMPLATES), Words(pa.array([text]), PLAIN))
    assert all(a[5] <= b[4] or b[5] <= a[4] for i, a in enumerate(matches) for b in matches[:i])
    return [m[0] for m in sorted(matches, key=lambda m: m[4])]


def test_relatives_are_told_apart():
    gpl = TEMPLATES["gpl-3.0-header"]
    assert names(gpl.replace("version 3", "version 2")) == ["gpl-2.0-header"]
    assert names(gpl.replace("GNU General", "GNU Lesser General")) == ["lgpl-3.0-header"]
    assert names(gpl.replace("GNU General", "GNU Affero General")) == ["agpl-3.0-header"]
    assert names(gpl.replace("version 3", "version 9")) == []
    assert names(TEMPLATES["gpl-2.0-only-header"].replace("version 2", "only version 2")) == ["gpl-2.0-only-header"]
    library = gpl.replace("This program", "This library").replace("GNU General", "GNU Lesser General")
    assert names(library.replace("version 3", "version 2.1")) == ["lgpl-2.1-header"]
    # bullets in place of numbers, the holder's name in place of the copyright holder
    bsd = TEMPLATES["bsd-3-clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("the copyright holder nor", "Acme Inc nor")
    assert names(bsd) == ["bsd-3-clause"]
    assert names(bsd.replace(bsd[bsd.index("* Neither"):bsd.index("THIS SOFTWARE")], "")) == ["bsd-2-clause"]
    assert names(TEMPLATES["apache-2.0-header"].replace("http:", "https:")) == ["apache-2.0-header"]
    assert names(TEMPLATES["mpl-2.0-header"] + "\n" + TEMPLATES["unlicense"]) == ["mpl-2.0-header", "unlicense"]
    assert names("Licensed under the Apache License, Version 1.1.") == []


def test_inserted_words_cost():
    mit = TEMPLATES["mit-grant"].split()
    spread = lambda n: " ".join(w + (f" not{i}" if i < 3 * n and i % 3 == 0 else "") for i, w in enumerate(mit))
    index = Index({"mit-grant": TEMPLATES["mit-grant"]})
    (few,), (many,) = (find(index, Words(pa.array([spread(n)]), PLAIN)) for n in (5, 20))
    assert few[0][:4] == ("mit-grant", 1.0, len(mit) + 1, 5)  # "and/or" is two words
    assert many == []


def test_recall_against_full_alignment():
    """Every template against every place of the text, without fingerprints or a narrow band."""
    rng = random.Random(8)
    short = {n: t for n, t in TEMPLATES.items() if len(t.split()) <= 60}
    index = Index(short)
    wanted = caught = 0
    for n in range(24):
        words = rng.choice(list(short.values())).split()
        for _ in range(rng.randint(0, len(words) // 6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [f"edit{rng.randrange(99)}"] * rng.randint(0, 1)
        text = " ".join([*filler(n, 20), *words, *filler(n + 99, 20)])
        one = Words(pa.array([text]), PLAIN)
        best = []
        for k, name in enumerate(index.names):
            pairs = align(index.words[k], one.hashes, 0, len(one.hashes) + len(index.words[k]))
            size = len(index.words[k])
            inserted = pairs[-1][1] + 1 - pairs[0][1] - len(pairs) if pairs else 0
            if pairs and index.versions[k] <= {i for i, _ in pairs} and len(pairs) >= 0.8 * (size + inserted):
                best.append((3 * len(pairs) - size - inserted, name))
        (got,) = find(index, one)
        assert bool(best) or not got
        wanted += bool(best)
        caught += bool(best) and bool(got) and max(best)[0] == max(3 * m[2] - len(index.words[index.names.index(m[0])]) - m[3] for m in got)
    assert wanted >= 15 and caught >= 0.9 * wanted, (caught, wanted)
