import random

from logloom.llm import license_scan

from .conftest import WORDS, alnum_words

SETS = {}


def shingles(text):
    w = alnum_words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text):
    s, out = shingles(text), set()
    for name, template in license_scan.TEMPLATES.items():
        own = shingles(template)
        reach, whole = len(own) + len(own) // 4, set(own)
        hits = [i for i, x in enumerate(s) if x in whole]
        if any(len({s[j] for j in hits if i <= j < i + reach}) >= 0.8 * len(whole) for i in hits):
            out.add(name)
    return out


def planted():
    rng = random.Random(5)
    out = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 3)):
            w = license_scan.TEMPLATES[rng.choice(sorted(license_scan.TEMPLATES))].split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            parts += [rng.choice(WORDS) for _ in range(rng.randint(0, 150))] + w
        out.append(" ".join(parts))
    return out


def test_finds_what_containment_says(make_docs, odd_texts):
    texts = [*odd_texts, *planted()]
    docs = make_docs(texts).selectExpr("*", "'x' as LICENSES")
    for r in license_scan.licenses(docs).collect():
        assert {m.license for m in r.licenses} == brute(texts[r.doc_id]), r.doc_id
        for m in r.licenses:
            own = set(shingles(license_scan.TEMPLATES[m.license]))
            there = set(shingles(texts[r.doc_id])[m.start_word : m.end_word - 4])
            assert len(there & own) / len(own) == m.containment >= 0.8
    assert license_scan.report(docs.limit(0)).count() == 0


def test_every_copy_is_reported(make_docs):
    line = license_scan.TEMPLATES["MIT-line"]
    filler = " ".join(WORDS)
    r = license_scan.report(make_docs([f"{line} {filler} {line} {filler} {license_scan.TEMPLATES['MIT']}"])).first()
    assert (r.n_matches, r.license_ids) == (3, "MIT,MIT-line")


def test_window_sizes_leave_no_template_out():
    for text in license_scan.TEMPLATES.values():
        n = len(alnum_words(text))
        assert any(n >= size + step - 1 for size, step in license_scan.SIZES)


def test_edited_copies_beside_better_ones_are_reported(make_docs):
    texts, want = [], []
    for name in ("MIT", "ISC", "Apache-2.0"):
        whole = license_scan.TEMPLATES[name].split()
        n = len(alnum_words(" ".join(whole)))
        for gap in (0, 1, 9, 60):
            for spots in ([0], [len(whole) // 3], [4, len(whole) // 2], [len(whole) - 1]):
                edited = [f"zz{i}" if i in spots else w for i, w in enumerate(whole)]
                between = [f"g{i}" for i in range(gap)]
                for copies in ([edited, whole], [whole, edited], [edited, edited, whole, edited], [whole, whole], [whole[: len(whole) // 2], whole]):
                    texts.append(" ".join(w for c in copies for w in [*c, *between]))
                    want.append((name, sum(len(c) == len(whole) for c in copies), any(c == whole for c in copies), n))
    for r in license_scan.licenses(make_docs(texts)).collect():
        name, copies, exact, n = want[r.doc_id]
        got = [m for m in r.licenses if m.license == name]
        assert len(got) == copies, (r.doc_id, got)
        assert not exact or any(m.containment == 1 and m.end_word - m.start_word == n for m in got), (r.doc_id, got)
        assert all(a.end_word - 4 <= b.start_word for a, b in zip(got, got[1:], strict=False))


def test_spdx_lines_full_texts_and_further_notices(make_docs):
    filler = " ".join(WORDS)
    texts = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: (GPL-2.0-or-later WITH x OR MIT)\nimport os", f"{filler}\n/* SPDX-License-Identifier: MIT OR Apache-2.0 */ int x;\nSPDX-License-Identifier: ISC", "SPDX-License-Identifier:", "MIT SPDX-License", "SPDX-License-Identifier: unknown"]
    want = [{("MIT-spdx", 0, 4)}, {("GPL-2.0-or-later-spdx", 0, 8)}, {("MIT-spdx", len(WORDS), len(WORDS) + 4), ("Apache-2.0-spdx", len(WORDS) + 5, len(WORDS) + 8), ("ISC-spdx", len(WORDS) + 10, len(WORDS) + 14)}, set(), set(), set()]
    known = license_scan.inventory()
    names = [f"{x}-text" for x in license_scan.FULL_TEXTS] + ["LGPL-notice", "AGPL-notice", "EPL-2.0", "CC0-1.0", "BSL-1.0", "BSL-1.0-line"]
    rows = license_scan.licenses(make_docs([*texts, *[f"{filler} {known[n]} {filler}" for n in names]])).collect()
    for r in rows:
        if r.doc_id < len(texts):
            assert {(m.license, m.start_word, m.end_word) for m in r.licenses} == want[r.doc_id]
        else:
            assert (names[r.doc_id - len(texts)], 1.0) in {(m.license, m.containment) for m in r.licenses}
