"""Each training-data operator against SQL or a brute-force version, and its defined results for odd input."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import ann, bpe, components, decision_list, empirical_bayes, langid, line_dedup, merkle, mixing, queries, simhash, stats, token_counts
from tests.harness import DATA, compare

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (2, "", "en", "a", 0),
    (None, "lorem ipsum dolor sit amet " * 9, "en", None, 9),
    (None, "other words without an id " * 9, "fr", "b", 9),
    (5, " \n\t\r\n ", "en", "b", 6),
    (6, "x" * 300_000, "en", "b", 300_000),
    (7, "word " * 70_000, "en", "b", 350_000),
    (7, "same id, other text, more than ten words here to be kept on", "de", "b", 1),
    (8, "ünï çödé ½ ² ١٢٣ 漢字かな 😀 é", "fr", "ü", 1),
]


def brute_print(text, size=4):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, edges):
    head = {n: n for n in nodes}

    def find(n):
        while head[n] != n:
            head[n] = head[head[n]]
            n = head[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        head[b] = a
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("fp", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("source_size", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_simhash_matches_brute_force(spark, docs):
    got = queries.op1_simhash(spark, DATA).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_print(t) for i, t in rows.items()}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(ids, links)
    assert len(got) == len(ids) and any(want[i] != i for i in ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("threshold", [1, 3, 4, 6])
def test_links_keep_every_component(spark, threshold):
    rng = random.Random(threshold)
    prints = {rng.getrandbits(64) for _ in range(500)}
    for center in list(prints)[:30]:
        for _ in range(40):
            prints.add(center ^ sum(1 << b for b in rng.sample(range(20), rng.randint(1, 5))))
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(4)
    found = {(r.a, r.b) for r in simhash.links(table, threshold).collect()}
    true = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= threshold}
    assert found <= true
    assert groups(prints, found) == groups(prints, true)


def test_simhash_odd_rows(odd, none):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and simhash.near_duplicates(none).count() == 0
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert sorted(r.doc_id for r in zero) == [1, 2, 2, 5] and {r.component_id for r in zero} == {1}
    kept = simhash.representatives(odd.union(odd.where("doc_id = 8")))
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and 2 not in ids and ids[8] == 1 and ids[7] == 2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}}


def test_classifier_tells_held_out_quality(spark, odd, none):
    out = {r.doc_id: r for r in queries.op2_quality_classifier(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(out) == 1000 and np.mean([out[r.doc_id].kept == (r.quality == 1) for r in held]) > 0.93
    flat = empirical_bayes.fit(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    rows = empirical_bayes.classify(odd, flat, "doc_id", "text", F.col("source"), F.col("lang")).collect()
    assert len(rows) == len(ODD) and all(0 < r.p_quality < 1 for r in rows)
    assert empirical_bayes.classify(none, flat, "doc_id", "text", F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_fall_back_to_the_prior(spark):
    good = empirical_bayes.Evidence(("r_words",), (0.0,), (1.0,), (1.0,), -3.0)
    rows = [(i, "w " * (40 if i % 5 else 1), "big") for i in range(200)] + [(900, "w " * 40, "alone"), (901, "w", "bad"), (902, "w", "bad")]
    out = {r.doc_id: r for r in empirical_bayes.classify(spark.createDataFrame(rows, "doc_id long, text string, source string"), good, "doc_id", "text", F.col("source"), F.lit("p")).collect()}
    mean = np.mean([r.p_doc for r in out.values()])
    assert abs(out[900].host_rate - mean) < 0.02
    assert out[901].path_rate < mean


def test_language_of_held_out_documents(spark, docs, odd, none):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op3_language_id(spark, DATA).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97
    model = langid.fit(langid.held_in(docs))
    found = {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (5, "und")} <= found and all(p in ("en", "fr", "de", "es", "und") for _, p in found)
    digits = spark.createDataFrame([(1, "12 ½ ² !!")], "doc_id long, text string")
    assert langid.identify(digits, model).first().lang_pred == "und"
    assert langid.identify(odd, langid.fit(none)).where("lang_pred != 'und'").count() == 0
    assert langid.identify(none, model).count() == 0


def test_unseen_words_back_off_to_shorter_grams():
    rows = lambda *v: np.array(v, dtype=float)
    model = langid.Model.of(["a", "b"], {"known": rows(-1, -9)}, [{"z": rows(-5, -2)}, {"zz": rows(-1, -7)}], rows(-20, -20))
    assert model.word_score("known").tolist() == [-1, -9]
    assert model.word_score("zz").tolist() == [(-20 - 1 - 5 - 20) / 4, (-20 - 7 - 2 - 20) / 4]
    assert model.predict("zz known")[0] == "a" and model.predict("77 ")[0] == "und"


def brute_stats(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit |= set(range(i, i + 5))
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rules_statistics_and_verdicts(spark, docs, odd, none):
    rows = {r.doc_id: r for r in queries.op4_quality_rules(spark, DATA).collect()}
    for d in docs.collect():
        r = rows[d.doc_id]
        assert tuple(r[1:6]) == brute_stats(d.text), d.doc_id
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert np.mean([rows[r.doc_id].kept for r in labels if r.quality == 1 and not rows[r.doc_id].base_failed]) > 0.98
    rules = decision_list.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert rules and decision_list.apply_rules(none, rules).count() == 0
    out = decision_list.apply_rules(odd, rules).collect()
    assert len(out) == len(ODD) and {r.doc_id: r.kept for r in out if r.doc_id in (1, 2, 5)} == {1: False, 2: False, 5: False}
    assert decision_list.kept_rows(odd, rules).columns == odd.columns
    assert decision_list.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == []


def test_learned_list_finds_planted_conjunction(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random(900), rng.random(900)
    rules = decision_list.learn({"a": a, "b": b}, (a > 0.6) & (b <= 0.4))
    got = np.zeros(900, dtype=bool)
    for r in rules:
        got |= r.holds({"a": a, "b": b})
    assert (got == ((a > 0.6) & (b <= 0.4))).mean() > 0.97
    table = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    assert [r[0] for r in table.select(~decision_list.verdict(rules)).collect()] == got.tolist()


@pytest.fixture(scope="module")
def tokens():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(tokens, text):
    ids = tokens.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_matches_the_library(spark, docs, tokens):
    got = {r.doc_id: tuple(r[1:]) for r in queries.op9_byte_bpe(spark, DATA).collect()}
    assert got == {d.doc_id: digests(tokens, d.text) for d in docs.collect()}


@pytest.mark.parametrize("spread", [100, 10_000])
@pytest.mark.parametrize("chunk,overlap", [(64, 16), (50, 50), (7, 3)])
def test_bpe_stitches_chunks(spark, tokens, chunk, overlap, spread):
    rng = random.Random(chunk)
    parts = ["don't", " we'll", "  \n\n", "\n", " ", "\t\t x", "aaaa" * 30, " 12345", "!!!", "é漢字", "😀", " ", "'s", "word", " word", " \r\n "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))) for i in range(150)] + [(150, None), (151, "q" * 500), (None, " " * 300), (0, "other " * 40)]
    rows += rows[:3]
    vocabulary = bpe.load(spark, queries.RANKS)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = bpe.encode(table, vocabulary, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap, spread=spread)
    own = bpe.encode(table, vocabulary, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap, spread=spread, decoded=True).collect()
    assert Counter((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in own) == Counter((i, *digests(tokens, t)) for i, t in rows)
    both = bpe.decode(out.withColumn("own", F.col("ids")), vocabulary, public_tokenizers.PATTERN, ["doc_id", "n_tokens", "own"]).collect()
    got = Counter((r.doc_id, r.n_tokens, hashlib.sha256(r.own).hexdigest(), hashlib.sha256(r.decoded).hexdigest()) for r in both)
    assert got == Counter((i, *digests(tokens, t)) for i, t in rows)


def test_most_texts_are_stitched(docs):
    long = [d.text for d in docs.collect() if d.text and len(d.text) > bpe.CHUNK]
    pieces = [bpe.pieces_of(t, public_tokenizers.PATTERN, bpe.CHUNK, bpe.OVERLAP) for t in long]
    assert len(long) > 300 and sum(map(len, long)) > 0.6 * sum(len(d.text or "") for d in docs.collect())
    assert all("".join(p) == t and (len(p) > 1 or len(t) <= bpe.CHUNK + bpe.OVERLAP) for p, t in zip(pieces, long))


def test_bpe_odd_rows(spark, odd, none, tokens):
    vocabulary = bpe.load(spark, queries.RANKS)
    got = Counter((r.doc_id, r.n_tokens) for r in bpe.encode(odd, vocabulary, public_tokenizers.PATTERN).collect())
    assert got == Counter((r[0], digests(tokens, r[1])[0]) for r in ODD)
    assert bpe.encode(none, vocabulary, public_tokenizers.PATTERN).count() == 0


def test_token_histogram(spark, docs, tokens, none):
    lengths = [len(tokens.encode_ordinary(d.text or "")) for d in docs.collect()]
    for r in queries.op5_token_counts(spark, DATA).collect():
        n = r.n_tokens
        assert (r.docs, r.docs_longer, r.tokens_upto) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x <= n))
        assert r.tokens_kept == sum(min(x, n) for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > n)
    table = token_counts.LengthTable(spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long"))
    assert table.totals() == (len(lengths), sum(lengths))
    for limit in (0, 1, 17, 512, 4096, 10**6):
        assert table.truncated(limit) == sum(min(x, limit) for x in lengths)
    assert table.quantile(0.5) == sorted(lengths)[499] and table.quantile(1.0) == max(lengths)
    empty = token_counts.LengthTable(spark.createDataFrame([], "n_tokens long"))
    assert empty.totals() == (0, 0) and empty.quantile(0.5) is None and empty.truncated(9) == 0


def test_fixity_audit_against_sql(spark):
    assert compare(spark, queries.op6_merkle_fixity, queries.ORACLE["op6_merkle_fixity"]) > 0


def test_fixity_of_odd_records(spark):
    page = "page_id long, url string, html string, slot int"
    rows = [(1, "u", "a", 0), (2, None, None, 0), (2, None, None, 0), (None, "v", "b", 0), (70_000, "w", "c" * 100_000, 0), (3, "x", "d", 0)]
    ours = merkle.records(spark.createDataFrame(rows, page))
    assert merkle.audit(ours, ours).count() == 0
    theirs = merkle.records(spark.createDataFrame([*rows[:1], *rows[1:2], *rows[3:5], (3, "x", "D", 0), (900_000, "n", "e", 0)], page))
    assert {(r.slot, r.status) for r in merkle.audit(ours, theirs).collect()} == {(2, "changed"), (3, "changed"), (900_000, "extra")}
    none = merkle.records(spark.createDataFrame([], page))
    assert merkle.audit(none, none).count() == 0
    assert {r.status for r in merkle.audit(ours, none).collect()} == {"missing"} and merkle.audit(none, ours).count() == 5


def test_a_damaged_offset_index_is_seen(spark):
    recs = merkle.records(spark.createDataFrame([(i, "u", "x" * i) for i in range(400)], "page_id long, url string, html string"), per_archive=100)
    leaf = merkle.leaves(recs).cache()
    index = leaf.select("slot", (F.col("first") + F.when(F.col("slot") == 77, 1).otherwise(0)).alias("first"), "last").where("slot != 300")
    got = merkle.audit_leaves(leaf, merkle.leaves(recs, index)).collect()
    assert {(r.slot, r.status) for r in got} == {(77, "moved"), (300, "moved")}
    assert merkle.audit_leaves(leaf, merkle.leaves(recs, leaf.select("slot", "first", "last"))).count() == 0
    # a longer record moves those after it in its archive
    longer = merkle.records(spark.createDataFrame([(i, "u", "x" * (i + (i == 97))) for i in range(400)], "page_id long, url string, html string"), per_archive=100)
    assert {(r.slot, r.status) for r in merkle.audit(recs, longer).collect()} == {(97, "changed"), (98, "moved"), (99, "moved")}


def test_archives_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    recs = merkle.records(pages, per_archive=100)
    made = merkle.archives(recs).collect()
    for r in made:
        (tmp_path / f"{r.archive}.warc").write_bytes(r.content)
    back = merkle.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.uri, r.payload.decode()) for r in back) == sorted((p.url, p.html) for p in pages.collect())
    for r in made:
        starts = [(at, size) for at, size, _, _ in merkle.parse(r.content)]
        (tmp_path / f"{r.archive}.warc.gz").write_bytes(b"".join(gzip.compress(r.content[a : a + n]) for a, n in starts) + b"\x1f\x8b\x08junk")
    packed = [r for r in merkle.read_archives(spark, str(tmp_path)).collect() if r.file.endswith(".gz")]
    assert sorted((r.uri, r.payload) for r in packed) == sorted((r.uri, r.payload) for r in back)
    for r in packed[:20]:
        assert r.payload in gzip.decompress((tmp_path / r.file.rsplit("/", 1)[1]).read_bytes()[r.offset : r.offset + r.length])
    spots = {(f"{r.archive}.warc", r["first"], r["last"] - r["first"]) for r in merkle.leaves(recs).collect()}
    assert spots == {(r.file.rsplit("/", 1)[1], r.offset, r.length) for r in back}
    assert list(merkle.parse(b"junk" + made[0].content[:200])) == []


def test_line_dedup_against_sql(spark):
    assert compare(spark, queries.op7_line_dedup, queries.ORACLE["op7_line_dedup"]) == 1000


def test_line_dedup_cases(spark, odd, none):
    schema = "doc_id long, text string, n_lines string"
    cases = [(1, "a\nb\n\nc\nd", "x"), (2, "z\na\nb\nc\ny", "x"), (3, "a\nb\nc", "x"), (3, "a\nb\nc", "x"), (4, "q\nq\nq\nq", "x"), (5, "a\nb", "x"), (None, "a\nb\nc\nw", "x"), (6, None, "x"), (7, "", "x")]
    got = Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(cases, schema)).collect())
    assert got == Counter([(1, "\nd", 3), (2, "z\ny", 3), (3, "", 3), (3, "", 3), (4, "q", 3), (5, "a\nb", 0), (None, "a\nb\nc\nw", 0), (6, None, 0), (7, "", 0)])
    out = line_dedup.dedup_lines(odd)
    assert out.count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0


def test_search_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.vec_id for r in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in queries.op8_ann(spark, DATA).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        a, b = x[ids == r.query_id][0], x[ids == r.vec_id][0]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    hits = []
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        hits.append(len(set(ids[order].tolist()) & set(got[int(q)])) / 5)
    assert len(got) == len(hits) and np.mean(hits) >= 0.9


def test_search_odd_vectors(spark):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("list", T.StringType()), T.StructField("VEC_ID", T.LongType())])
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0]), (8, [-1.0, 0.0]), (None, [1.0, 0.0]), (50, [0.0, 3.0]), (9, []), (100, [0.0, 2.0, 0.0])]
    found = lambda rows: [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(spark.createDataFrame([(*r, "x", 1) for r in rows], kind), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    # both rows of id 2 count, and a vector of three numbers meets those of three
    want = [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 2, 1.0), (0, 4, 50, 0.0), (0, 5, 8, -1.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0), (50, 4, 2, 0.0), (50, 5, 8, 0.0), (100, 1, 7, 0.0)]
    assert found(rows) == want
    twice = found([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [1.0, 0.01]), (0, [1.0, 0.0])])
    assert [(q, r, i) for q, r, i, _ in twice] == [(0, 1, 0), (0, 2, 1), (0, 3, 1)] and abs(twice[1][3] - 0.99995) < 1e-5 and abs(twice[2][3] - 0.99388) < 1e-5
    assert found([]) == []


def test_mixing_against_sql(spark):
    assert compare(spark, queries.op10_mixing, queries.ORACLE["op10_mixing"]) == 1000


def test_mixing_shares_and_odd_rows(spark, odd, none):
    sizes = [("a", 100), ("b", 1000), ("c", 1000), ("d", 5), ("e", 10_000), (None, 700), ("f", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order, asked = ["a", "b", "c", "d", "e", "f", None], 1.5 * sum(n for _, n in sizes)
    weight, size, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, dict(sizes), set()
    while True:
        rest = asked - sum(2 * size[s] for s in full)
        share = {s: 2 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if share[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    assert list(mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).columns) == ["source", "source_size", "target"]
    assert all(abs(got[s] - share[s]) < 1e-6 for s in order) and abs(sum(got.values()) - asked) < 1e-6
    plan = mixing.planned(odd).collect()
    assert len(plan) == len(ODD) and all(0 <= r.copies <= 2 for r in plan)
    assert Counter((r.doc_id, r.size) for r in plan) == Counter((r[0], brute_stats(r[1])[0]) for r in ODD)
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() == sum(r.copies for r in plan)
    assert mixing.planned(none).count() == 0
    # more sources than are broadcast
    key = lambda r: repr(tuple(r))
    assert sorted(mixing.planned(odd, few=0).collect(), key=key) == sorted(plan, key=key)
    assert sorted(map(repr, mixing.mix(odd, few=0).collect())) == sorted(map(repr, mixing.mix(odd).collect()))


def test_mixing_comes_near_its_targets(spark):
    rows = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(30_000)], "doc_id long, text string, source string")
    by = mixing.planned(rows).groupBy("source_size").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert len(by) == 3 and all(abs(r.taken / r.target - 1) < 0.03 for r in by)


def test_statistics_of_nothing():
    assert stats.describe(None) == stats.describe(b"") == (0,) * len(stats.NAMES)
