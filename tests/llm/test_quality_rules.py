import random

import numpy as np

from memlake.llm import quality_rules as q

FLOORS = np.diag(np.array(q.FLOORS) ** 2)


def statistics(r):
    """From the base counts, in plain numpy."""
    n, c = max(r.n_words, 1), max(r.word_chars, 1)
    x = [np.log(1 + r.n_words), np.log(1 + r.word_chars / n), np.sqrt(r.n_symbols / c), np.sqrt(r.n_dup_lines / max(r.n_lines, 1)), np.sqrt(r.n_repeat_words / n), np.sqrt(r.n_upper / c)]
    return np.floor(q.UNITS * np.array(x))


def far(x, m, c):
    z = np.linalg.solve(np.linalg.cholesky(c + FLOORS), (x - m).T)
    return (z * z).sum(axis=0)


def concentrated(own, starts, moments):
    """(mean, covariance) of rows after steps from starts, with numpy's linear algebra; moments(core) gives a step's."""
    now = [(m, c, np.inf) for m, c in starts]
    while True:
        tried = []
        for old in now:
            rank = np.floor(16 * np.sqrt(far(own, old[0], old[1])))
            m, c = moments(own[rank <= np.percentile(rank, 100 * q.CORE)])
            det = np.sqrt(np.linalg.det(c + FLOORS))
            tried.append((m, c, det) if det < old[2] * (1 - 1e-12) else old)
        if all(a is b for a, b in zip(tried, now)):
            return now[0][:2]
        now = [min(tried, key=lambda e: e[2])]


def middle(own):
    m = np.floor(np.median(own, axis=0))
    return m, np.diag((1.4826 * np.median(abs(own - m), axis=0)) ** 2)


def brute_force(rows):
    """Distances of rows (language, source, statistics), group by group."""
    groups = {}
    for i, (lang, source, _) in enumerate(rows):
        groups.setdefault((lang, source), []).append(i)
    x = np.array([s for _, _, s in rows])
    alone = lambda core: (core.mean(axis=0), np.cov(core.T, bias=True))
    centred = np.concatenate([x[members] - middle(x[members])[0] for members in groups.values()])
    within = concentrated(centred, [middle(centred)], alone)[1]
    every = concentrated(x, [middle(x)], alone)

    def borrowing(core):
        n = len(core)
        scatter = n / (n + q.BORROWED) * np.cov(core.T, bias=True) + q.BORROWED / (n + q.BORROWED) * within
        return (n * core.mean(axis=0) + every[0]) / (n + 1), (n * scatter + every[1]) / (n + 1)

    out = {}
    for members in groups.values():
        m, c = concentrated(x[members], [middle(x[members]), (middle(x[members])[0], within)], borrowing)
        out |= dict(zip(members, far(x[members], m, q.CONSISTENCY * c)))
    return [out[i] for i in range(len(rows))]


def made():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    loud = lambda n: " ".join(word().upper() + "#|" for _ in range(n))
    texts = [(prose(rng.randint(30, 300)), "en", "a") for _ in range(150)] + [(loud(rng.randint(30, 300)), "en", "b") for _ in range(150)]
    texts += [(prose(rng.randint(30, 300)), "fr", "a") for _ in range(8)] + [(prose(90), None, None), (loud(120), "en", "a"), (prose(120), "en", "b"), ("few words", "en", "a"), (None, "en", "a")]
    return [(n, *t) for n, t in enumerate(texts)]


def test_distances_against_numpy(spark):
    texts = made()
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    counts = {r.id: r for r in q.base_counts(docs).collect()}
    good = [t for t in texts if not counts[t[0]].base_failed]
    want = dict(zip([t[0] for t in good], brute_force([(t[2], t[3], statistics(counts[t[0]])) for t in good])))
    got = {r.doc_id: r for r in q.quality_verdicts(docs).collect()}
    assert set(got) == {t[0] for t in texts}
    for i, r in got.items():
        assert (r.distance is None) == (i not in want) and (i in want or not r.kept)
        if i in want:
            assert abs(r.distance - want[i]) < 1e-6 * max(1, want[i]) and r.kept == (want[i] <= q.CUTOFF)
    # the same kind of text is ordinary in one source and an outlier in the other, and no group is too small for a verdict
    assert not got[309].kept and not got[310].kept and all(got[i].kept for i in range(100, 200))


def test_quantiles():
    """Against tables of the chi-square law."""
    for share, degrees, value in ((0.95, 2, 5.991), (0.975, 6, 14.449), (0.999, 6, 22.458), (0.5, 8, 7.344)):
        assert abs(q.chi_square_quantile(share, degrees) - value) < 1e-3
    assert abs(q.CONSISTENCY - 1.3616) < 1e-3


def test_names_of_inner_columns_don_t_clash(spark):
    docs = spark.createDataFrame([(n, t, x, s, "i", 1, 2, "d") for n, t, x, s in made()[:40]], "doc_id long, text string, lang string, source string, id string, hash int, bad_id int, doc string")
    kept = q.keep_good_texts(docs)
    assert kept.columns == docs.columns and kept.filter("id = 'i' AND hash = 1 AND bad_id = 2 AND doc = 'd'").count() == kept.count() > 30


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(30, 300))) for _ in range(300)]
    odd = [" ".join(word().upper() + "###|||" for _ in range(100)) for _ in range(5)]
    df = spark.createDataFrame([(n, t, "en", "s") for n, t in enumerate(texts + odd)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in q.quality_verdicts(df).filter("NOT kept").collect()} == set(range(300, 305))


def test_steps_end_before_those_of_the_statement(spark, monkeypatch):
    from memlake.llm import sql
    from memlake.llm.tables import Scratch

    names, saved = [], Scratch.saved
    monkeypatch.setattr(Scratch, "saved", lambda self, df, name: names.append(name) or saved(self, df, name))
    q.quality_verdicts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    # a loop saves its starts, and then limits and estimates at each step
    steps, before = [0], ""
    for name in names:
        if name == "limits":
            steps[-1] += 1
        elif name == before == "estimates":
            steps.append(0)
        before = name
    assert steps[-1] == 0 and len(steps) == 3 and all(0 < n <= sql.SQL_STEPS for n in steps[:2])
