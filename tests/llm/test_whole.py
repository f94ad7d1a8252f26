"""Cases in which a cache that fills or a hot group once cost results."""

import functools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandweave.llm import ann, bpe, decision_list, empirical_bayes, langid, line_dedup, mixing, queries, sampling, simhash, stats
from tests.harness import DATA


def nearest_ids(ids, x, query, k=5):
    own = x[ids == query][0]
    score = (x * own).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((own * own).sum()))
    return [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != query][:k]


def test_full_word_cache_keeps_predictions(monkeypatch):
    monkeypatch.setattr(langid, "_ROWS", 64)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    langs = ["a", "b", "c"]
    model = langid.Model.of(langs, {w: np.array([rng.uniform(-12, -1) for _ in langs]) for w in vocabulary[:300]}, [{}], np.full(3, -20.0))
    for _ in range(200):
        text = " ".join(vocabulary[int(400 * rng.random() ** 2)] for _ in range(rng.choice([5, 50, 300])))
        words = langid.words_of(text)
        total = sum(model.word_score(w) for w in words)
        lang, score = model.predict(text)
        assert lang == langs[int(np.argmax(total))] and abs(score - 1 / np.exp((total - total.max()) / len(words)).sum()) < 1e-9


def test_search_takes_the_least_ids_of_thousands_of_copies(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=16).round(2), (3000, 1)), rng.normal(size=(1500, 16)).round(2)])
    ids = rng.permutation(len(x))
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    queries = [int(i) for i in ids[:3000] if i % 100 == 0]
    got = ann.search(rows, F.col("vec_id") % 100 == 0).where(F.col("query_id").isin(queries)).orderBy("query_id", "rank").collect()
    assert len(queries) > 10 and [(r.query_id, r.vec_id) for r in got] == [(q, i) for q in sorted(queries) for i in nearest_ids(ids, x, q)]


def test_a_group_of_near_copies_gives_its_true_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + np.concatenate([rng.normal(size=(2500, 8)) * 1e-3, rng.normal(size=(1500, 8))])
    ids, unit = rng.permutation(len(x)), x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    slices = np.array_split(np.arange(8), 4)
    index = ann.Index(8, unit.mean(axis=0)[None, :], slices, [], 0.0)
    index.books = [ann.kmeans((unit - index.centers[0])[:, s], 16, 1) for s in slices]
    codes = [c.tobytes() for c in index.encode(unit, np.zeros(len(x), dtype=int))]
    asked = ids[::97]
    left = pa.table({"vec_id": ids, "vec": x.tolist(), "list": np.zeros(len(x), int), "codes": pa.array(codes, pa.binary())})
    right = pa.table({"query_id": asked, "vec": x[::97].tolist(), "query_key": asked, "lists": [[0]] * len(asked)})
    got = ann._grouped(index, 5, 200)((pa.scalar(0),), left, right)
    assert got["vec_id"].to_pylist() == [i for q in asked for i in nearest_ids(ids, x, q)]


def test_an_outlier_with_its_own_list_finds_k_rows(spark, monkeypatch):
    index = ann.Index(2, np.array([[1.0, 0.0], [-1.0, 0.0]]), [np.arange(2)], [np.zeros((1, 2))], 0.0)
    monkeypatch.setattr(ann, "fit", lambda *a, **k: index)
    rows = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(1, 50)] + [(50, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.search(rows, F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [49, 48, 47, 46, 45]


def test_lists_go_on_until_they_hold_enough():
    index = ann.Index(2, np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), [], [], 0.0)
    lists = index.lists(np.array([[1.0, 0.1], [0.1, 1.0]]), np.array([1, 4, 9]), 6)
    assert [x.tolist() for x in lists] == [[0, 1, 2], [1, 0, 2]]


def test_codes_prune_and_lists_grow(spark):
    rng = np.random.default_rng(8)
    n, dim = 12_000, 24
    x = np.concatenate([rng.normal(size=(60, dim))[rng.integers(60, size=n // 2)] + rng.normal(size=(n // 2, dim)) * 0.3, rng.normal(size=(n // 2, dim))])
    ids = rng.permutation(n)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, vec array<double>").withColumn("dim", F.lit(dim)).cache()
    unit, want = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        want[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, -score)) if i != q][:5]
    for exact in (False, True):
        found = ann._found(spark, rows, {dim: n}, F.col("vec_id") % 50 == 0, 5, 48, 4000, exact).cache()
        got = {}
        for r in ann._ranked(found, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        hits = np.mean([len(set(want[q]) & set(got[q])) / 5 for q in want])
        scored = found.groupBy("query_id").agg((F.sum("exact") / 5).alias("n")).agg(F.avg("n")).first()[0] / n
        assert hits == 1 if exact else hits >= 0.9 and scored < 0.05, (exact, hits, scored)
    index = ann.fit(rows, dim, n, 4000)
    assert 90 <= len(index.centers) <= 130 and n / len(index.centers) > 48


def brute_posterior(rows, evidence):
    """p_doc and p_quality of (host, path, text) rows, in NumPy."""
    from tests.llm.test_ops import brute_stats

    p = []
    for _, _, text in rows:
        n, chars, symbols, dup, repeated = brute_stats(text)
        words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.strip()]
        upper, marks = sum(c.isascii() and c.isupper() for c in text or ""), sum(33 <= ord(c) < 127 and not c.isalnum() for c in text or "")
        ratios = [n, chars / max(n, 1), symbols / max(n, 1), dup / max(len(lines), 1), repeated / max(n, 1), upper / max(chars, 1), marks / max(chars, 1), len(set(words)) / max(n, 1)]
        z = np.clip((np.log1p(ratios) - evidence.center) / evidence.scale, -6, 6) @ evidence.weights + evidence.bias
        p.append(np.clip(1 / (1 + np.exp(-z)), 1e-4, 1 - 1e-4))
    p, logit = np.array(p), lambda v: np.log(v / (1 - v))
    host, path = {}, {}
    for (h, s, _), v in zip(rows, p):
        for d, key in ((host, h), (path, (h, s))):
            d[key] = d.get(key, np.zeros(2)) + (1, v)
    prior = np.clip(p.mean(), 1e-4, 1 - 1e-4)

    def strength(groups, mean):
        seen = sum(n * (k / n - mean(g)) ** 2 for g, (n, k) in groups.items())
        noise = sum(mean(g) * (1 - mean(g)) for g in groups)
        return np.clip(prior * (1 - prior) / max(max(0.0, seen - noise) / len(p), 1e-6) - 1, 1, 1e4)

    hs = strength(host, lambda g: prior)
    ps = strength(path, lambda g: (host[g[0]][1] + hs * prior) / (host[g[0]][0] + hs))
    out = []
    for (h, s, _), v in zip(rows, p):
        a = np.clip((host[h][1] - v + hs * prior) / (host[h][0] - 1 + hs), 1e-4, 1 - 1e-4)
        b = np.clip((path[h, s][1] - v + ps * a) / (path[h, s][0] - 1 + ps), 1e-4, 1 - 1e-4)
        out.append((v, 1 / (1 + np.exp(-(logit(v) - logit(evidence.prior) + logit(b))))))
    return out


def test_classifier_query_against_numpy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    evidence = empirical_bayes.fit(docs, labels)
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute_posterior([(r.source, r.lang, r.text) for r in rows], evidence)))
    got = queries.op2_quality_classifier(spark, DATA).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.p_doc - want[r.doc_id][0]) < 1e-9 and abs(r.p_quality - want[r.doc_id][1]) < 1e-9 and r.kept == (r.p_quality >= 0.5)


def test_planted_sites_move_the_verdict(spark):
    good, bad, middling = "w " * 60, "w", "w " * 7
    rows = [(i, good if i % 10 else bad, "fine", "x") for i in range(300)] + [(1000 + i, bad if i % 10 else good, "poor", "y") for i in range(300)]
    rows += [(5000, middling, "fine", "x"), (5001, middling, "poor", "y"), (5002, middling, "unheard", "z")]
    evidence = empirical_bayes.Evidence(("r_words",), (0.0,), (1.0,), (2.0,), -4.1)
    table = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = {r.doc_id: r for r in empirical_bayes.classify(table, evidence, "doc_id", "text", F.col("host"), F.col("path")).collect()}
    assert got[5000].kept and not got[5001].kept and got[5001].p_quality < got[5002].p_quality < got[5000].p_quality
    assert abs(got[5002].p_quality - got[5002].p_doc) < 0.1


def test_thinned_labels_keep_the_prior(spark):
    rng = random.Random(3)
    rows = [(i, "w " * (rng.randint(20, 60) if i % 10 else rng.randint(1, 25)), int(i % 10 > 0)) for i in range(3000)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    mean = []
    for most in (6000, 150):
        evidence = empirical_bayes.fit(docs, labels, most=most, held_out=None)
        out = empirical_bayes.classify(docs, evidence, "doc_id", "text", F.lit("h"), F.lit("p"))
        mean.append(out.agg(F.avg("p_doc")).first()[0])
        assert abs(evidence.prior - 0.9) < 1e-9
    assert abs(mean[0] - 0.9) < 0.02 and abs(mean[1] - mean[0]) < 0.03


def test_language_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 != 2 and d.lang is not None]
    langs = sorted({d.lang for d in learned})
    counts = [{lang: Counter() for lang in langs} for _ in range(6)]
    for d in learned:
        for word in re.findall(r"[^\W\d_]+", d.text.lower()):
            counts[0][d.lang][word] += 1
            marked = f"^{word}$"
            for size in range(1, 6):
                counts[size][d.lang].update(marked[i : i + size] for i in range(len(marked) - size + 1))
    totals = [[sum(by[lang].values()) for lang in langs] for by in counts]
    known = [set().union(*by.values()) for by in counts]

    @functools.cache
    def row(size, item):
        return np.array([np.log((counts[size][lang][item] + 0.1) / (t + 1)) for lang, t in zip(langs, totals[size])])

    @functools.cache
    def score(word):
        if word in known[0]:
            return row(0, word)
        marked, out = f"^{word}$", np.zeros(len(langs))
        for i in range(len(marked)):
            size = next((s for s in range(min(5, len(marked) - i), 0, -1) if marked[i : i + s] in known[s]), None)
            out = out + (row(size, marked[i : i + size]) if size else -20.0)
        return out / len(marked)

    got = {r.doc_id: r for r in queries.op3_language_id(spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall(r"[^\W\d_]+", (d.text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            assert got[d.doc_id].lang_pred == "und" and got[d.doc_id].score == 0
            continue
        total = sum(score(w) for w in words)
        share = np.exp((total - total.max()) / len(words))
        assert got[d.doc_id].lang_pred == langs[int(np.argmax(total))] and abs(got[d.doc_id].score - share.max() / share.sum()) < 1e-9
    spread = np.quantile([r.score for r in got.values() if r.lang_pred != "und"], [0.01, 0.5])
    assert spread[0] < 0.995 and spread[1] > 0.8


def test_sample_of_very_many_classes_is_bounded(spark):
    rows = spark.createDataFrame([(i, f"c{i % 900}") for i in range(9000)], "id long, klass string")
    assert 700 < sampling.sample_by_class(rows, "klass", "id", 8, in_all=1800).count() < 2900
    assert sampling.sample_by_class(rows.withColumn("klass", F.lit("one")), "klass", "id", 50).count() < 120


def test_rule_verdicts_against_plain_python(spark):
    from tests.llm.test_ops import brute_stats

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").collect(), spark.read.parquet(f"{DATA}/labels.parquet").collect()
    ratios = {}
    for d in docs:
        n, chars, symbols, dup, repeated = brute_stats(d.text)
        text, words, lines = d.text or "", (d.text or "").split(), [x for x in (d.text or "").split("\n") if x.strip()]
        upper, marks = sum(c.isascii() and c.isupper() for c in text), sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
        row = (n, chars / max(n, 1), symbols / max(n, 1), dup / max(len(lines), 1), repeated / max(n, 1), upper / max(chars, 1), marks / max(chars, 1), len(set(words)) / max(n, 1))
        ratios[d.doc_id] = dict(zip(stats.RATIOS, map(float, row))), n < 10 or 100 * repeated > 20 * n
    taught = sorted((r.doc_id, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and not ratios[r.doc_id][1])
    rows = {k: np.array([ratios[i][0][k] for i, _ in taught]) for k in stats.RATIOS}
    rules = decision_list.learn(rows, np.array([q == 0 for _, q in taught]))
    assert rules
    for r in queries.op4_quality_rules(spark, DATA).collect():
        own, failed = ratios[r.doc_id]
        first = next((i for i, rule in enumerate(rules) if all(own[t.name] > t.limit if t.above else own[t.name] <= t.limit for t in rule.tests)), None)
        assert r.kept == (not failed and first is None) and r.rule == (None if first is None else first + 1)


CLASH = ["_c0", "_c1", "_id", "_h", "_lines", "_worded", "_left", "_gone", "_at", "_k1", "_k2", "_k", "_copy", "_copies", "_size", "_source", "_n", "_text", "_ids", "_bits", "_page", "_b", "_maybe", "fp", "root", "least", "word", "label", "dim", "list", "DOC_ID", "Text", "SOURCE", "n_words", "kept"]


def test_columns_of_any_name_pass_through(spark):
    text = "one two three four five six seven eight nine ten\neleven twelve thirteen fourteen\na line of its own here"
    docs = spark.createDataFrame([(1, text, "en", "s", 9), (2, text, "en", "s", 9), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASH)])
    rules = [decision_list.Rule((decision_list.Test("r_words", False, 3.0),), 1.0, 9)]
    for run in (line_dedup.dedup_lines, lambda d: line_dedup.dedup_lines(d, few=0), simhash.representatives, mixing.mix, lambda d: mixing.mix(d, few=0), lambda d: decision_list.kept_rows(d, rules)):
        plain, out = run(docs), run(more)
        assert [c for c in out.columns if c not in plain.columns] == CLASH
        rows, names = out.collect(), out.columns
        assert rows and all(r[names.index(c)] == f"v{i}" for r in rows for i, c in enumerate(CLASH))
        assert sorted(repr([r[names.index(c)] for c in plain.columns]) for r in rows) == sorted(repr(list(r)) for r in plain.collect())
    twice = line_dedup.dedup_lines(docs.withColumn("N_LINES", F.lit("x")))
    assert twice.columns == [*docs.columns, "n_lines", "n_removed"]
    evidence = empirical_bayes.Evidence(("r_words",), (0.0,), (1.0,), (1.0,), -3.0)
    model = langid.fit(docs)
    vocabulary = bpe.load(spark, queries.RANKS)
    for run in (simhash.near_duplicates, mixing.planned, lambda d: decision_list.apply_rules(d, rules), lambda d: langid.identify(d, model), lambda d: bpe.encode(d, vocabulary, public_tokenizers.PATTERN), lambda d: empirical_bayes.classify(d, evidence, "doc_id", "text", d["lang"], F.lit("p"))):
        assert sorted(map(repr, run(more).collect())) == sorted(map(repr, run(docs).collect()))
    assert langid.fit(more).langs == ["en"] and decision_list.fit(more, spark.createDataFrame([(1, 0)], "doc_id long, quality int")) is not None


def test_hot_windows_and_many_repeats_lose_nothing(spark):
    """A window that a third of all documents hold, with the repeats broadcast and by way of the bitmap."""
    from tests.llm.test_pipeline import brute_lines

    rng = random.Random(6)
    shared = "terms of use apply\nall rights are reserved\nsee the notice below"
    rows = []
    for i in range(900):
        lines = [" ".join(rng.choices("abcdefghij", k=6)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        if i % 50 == 7:
            lines = rows[rng.randrange(len(rows))][1].split("\n")
        rows.append((i, "\n".join(lines)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: t for (i, _), t in brute_lines([Row(doc_id=i, text=t) for i, t in rows]).items()}
    for few in (line_dedup.FEW, 0):
        out = line_dedup.dedup_lines(table, few=few)
        assert {r.doc_id: r.text for r in out.collect()} == want
    spots = line_dedup.repeated_windows(table)
    assert spots.count() > 280 and "BroadcastHashJoin" in spots._jdf.queryExecution().toString()
