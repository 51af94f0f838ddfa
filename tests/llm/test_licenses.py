import re

import numpy as np
import pytest

from lustrum.llm import licenses as L

TEXTS = [
    (1, "Prose.\nReleased under the MIT License.\nMore prose."),
    (2, "This work is licensed under the GNU General Public License, version 3."),
    (3, "licensed under the apache license, version 2.0.\nLicensed under CC BY-NC 4.0."),
    (4, "Licensed under the Eclipse Public License, version 2.0."),
    (5, "The license plate of the car was blue."),
    (6, "Nothing of the kind here, only words."),
    (7, None), (8, ""), (9, "Released under the MIT License.\nReleased under the MIT License."), (9, "Released under the MIT License.\nReleased under the MIT License."),
    (10, "Copyright (c) 2020 Someone. All rights reserved."),
    (11, "x " * 20_000 + "\nThis Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (None, "Licensed under CC BY-SA 4.0."),
]


def slow(text):
    """(paragraph, family, confirmed), without anchors."""
    m = L.train()
    out = []
    for par, part in enumerate(L.paragraphs_of(text or "")):
        words = L.words_of(part)
        met = [m.weights[g] for g in L.grams_of(words) if g in m.weights]
        sums = [m.bias[k] + sum(w[k] for w in met) for k in range(len(L.CLASSES))]
        sure = [f for k, f in enumerate(L.FAMILIES) if sums[k] >= m.cuts[k]]
        for family in sure or ["unknown"] * (sums[-1] >= m.cuts[-1]):
            own = L.shingles_of(words)
            alike = max((len(own & s) / min(len(own), len(s)) for s in map(L.shingles_of, map(L.words_of, L.TEMPLATES.get(family, ())))), default=0)
            out.append((par, family, alike >= L.ALIKE))
    return out


#: what the scan must say of each text: families of all its paragraphs
JUDGED = [
    ("CC BY-SA 4.0", ["cc-by-sa-4.0"]), ("Text: CC BY 4.0", ["cc-by-4.0"]), ("All rights reserved.", ["unknown"]), ("GNU Lesser General Public Licence", ["unknown"]),
    ("Apache License, Version 1.1", ["unknown"]), ("Apache-2.0 OR MIT", ["apache-2.0", "mit"]), ("Licensed under the Apache\nLicense, Version 2.0.", ["apache-2.0"]),
    ("Released under the MIT\nLicense.\nLicensed under CC BY 4.0.\n\nProse.", ["mit", "cc-by-4.0"]), ("The license plate of the car was blue.", []), ("Er kam mit dem Rad.", []),
]


def test_judged_texts(make_docs):
    for text, want in JUDGED:
        assert [f for _, f, _ in slow(text)] == want, text
    got = L.scan(make_docs([(i, t) for i, (t, _) in enumerate(JUDGED)], extra=True)).orderBy("doc_id", "par", "family").collect()
    assert sorted((r.doc_id, r.family) for r in got) == sorted((i, f) for i, (_, want) in enumerate(JUDGED) for f in want)


def test_anchors_lose_nothing(make_docs):
    m = L.train()
    assert all(b < c for b, c in zip(m.bias, m.cuts, strict=True))
    anchored = lambda g: any(re.search(rf"(?<![0-9a-z]){a}(?![0-9a-z])", g) for a in m.anchors)
    assert all(map(anchored, m.weights))
    texts = [t for t, *_ in L.examples()][::7]
    got = {}
    for r in L.scan(make_docs(list(enumerate(texts)))).collect():
        got.setdefault(r.doc_id, []).append((r.par, r.family, r.confirmed))
    assert all(sorted(got.get(i, [])) == sorted(slow(t)) for i, t in enumerate(texts))


def test_names_and_frames_that_the_fit_did_not_see():
    held = [(t, kind) for t, kind, unseen, _ in L.examples() if unseen]
    want = [sorted((kind or "").split("+")) if kind not in (None, L.ANY) else ["unknown"] if kind else [] for _, kind in held]
    right = sum(sorted(f for _, f, _ in slow(t)) == w for (t, _), w in zip(held, want, strict=True))
    assert len(held) > 800 and right / len(held) >= 0.94


def test_a_plainer_fit_decides_alike():
    """Plain subgradient steps on floats, no rounding: the same classes for nearly all unseen examples."""
    rows = L.examples()
    _, x, y = L.design(rows)
    held, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    xs, share = x[~held], (weight[~held] / weight[~held].sum())[:, None]
    w = np.zeros((x.shape[1], y.shape[1]))
    for k in range(1500):
        step = xs.T @ (share * (1 / (1 + np.exp(-xs @ w)) - y[~held]))
        step[:-1] += 2e-4 * np.sign(w[:-1])
        w -= (1.0 if k < 1000 else 0.3) * step
    m = L.train()
    plain = x[held] @ w * L.SCALE >= np.array(m.cuts)
    sums = np.array([[m.bias[k] + sum(m.weights[g][k] for g in L.grams_of(L.words_of(t)) if g in m.weights) for k in range(len(L.CLASSES))] for t, _, unseen, _ in rows if unseen])
    assert ((sums >= np.array(m.cuts)) == plain).mean() >= 0.97


def test_documents(make_docs):
    got = L.scan_documents(make_docs(TEXTS, extra=True)).collect()
    want = []
    for i, t in TEXTS:
        rows = slow(t)
        want.append((i, ",".join(sorted({f for _, f, sure in rows if sure})), len(rows), sum(s for *_, s in rows), sum(f == "unknown" for _, f, _ in rows)))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    by = {r.doc_id: r for r in got}
    assert by[1].families == "mit" and by[2].families == "gpl-3.0" and by[3].families == "apache-2.0,cc-by-nc-4.0"
    assert by[4].families == "" and by[4].n_unknown == 1 and by[10].n_unknown == 1
    assert by[6].n_licence == by[7].n_licence == 0 and by[11].families == "mpl-2.0"


@pytest.mark.parametrize("family", L.FAMILIES)
def test_every_template_is_told(family):
    for text in L.TEMPLATES[family]:
        assert [f for _, f, _ in slow(text)] == [family], text


def test_held_out_notices(make_docs):
    variants = [(f, f"Note to readers of this page: {t} Thank you.") for f in L.FAMILIES for t in L.TEMPLATES[f]]
    got = {r.doc_id: r.families for r in L.scan_documents(make_docs([(i, t) for i, (_, t) in enumerate(variants)])).collect()}
    right = sum(got[i] == f for i, (f, _) in enumerate(variants))
    assert right / len(variants) >= 0.85


def test_empty_table(make_docs):
    assert L.scan_documents(make_docs([])).collect() == []
