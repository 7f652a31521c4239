import math
import random
from collections import Counter

from logloom.llm import backoff_lm

from .conftest import prose, spaced_words


def brute(texts, order, alpha):
    words = [spaced_words(t) for t in texts]
    grams = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(order + 1)] for w in words]
    total = [sum((g[n] for g in grams), Counter()) for n in range(order + 1)]
    out = []
    for d, w in enumerate(words):
        rest = lambda g, d=d: total[len(g)][g] - grams[d][len(g)][g]
        score = lower = 0
        for i in range(len(w)):
            top = min(order, i + 1)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log(max(rest(g), 0.5) / max(1, sum(map(len, words)) - len(w))) + (top - 1) * math.log(alpha)
                elif rest(g) > 0:
                    score += math.log(rest(g) / rest(g[:-1])) + (top - n) * math.log(alpha)
                    break
            lower += n < top
        out.append((len(w), lower, score if w else None))
    return out


def test_matches_brute_force_for_any_pages(make_docs, odd_texts):
    rng = random.Random(6)
    texts = [*(t for t in odd_texts if t is None or len(t) < 5000), *(prose(rng, rng.randint(0, 60)) for _ in range(80))]
    texts += texts[-3:]
    docs = make_docs(texts).repartition(3)
    for order, page, part, most in ((3, 1 << 20, 1 << 20, 4096), (3, 200, 300, 4096), (4, 500, 64, 4096), (3, 200, 300, 2), (1, 100, 100, 0)):
        want = brute(texts, order, 0.4)
        got = backoff_lm.scored(docs, order=order, page_words=page, partition_grams=part, max_parts=most).collect()
        assert len(got) == len(texts)
        for r in got:
            n, lower, score = want[r.doc_id]
            assert (r.n_words, r.n_backoff) == (n, lower)
            assert r.log_score is None if score is None else math.isclose(r.log_score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_empty_tables(make_docs):
    assert backoff_lm.scored(make_docs(["a"]).limit(0)).count() == 0
    got = backoff_lm.report(make_docs([None, ""])).collect()
    assert [(r.n_words, r.n_backoff, r.mean_log_score) for r in got] == [(0, 0, None)] * 2


def test_long_text_and_null_ids(make_docs, odd_texts):
    got = backoff_lm.report(make_docs([odd_texts[3], odd_texts[3], "q"], [None, None, 1])).collect()
    assert sorted(r.n_words for r in got) == [1, 60_000, 60_000]
