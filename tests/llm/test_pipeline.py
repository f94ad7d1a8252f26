"""The pipeline's stages in turn, each held against a brute-force version on its own input."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from strandweave.llm import decision_list, mixing, shared_shingles, simhash
from tests.harness import DATA
from tests.llm.test_ops import DOC, ODD, brute_print, brute_stats, groups


def brute_lines(rows):
    """Texts by (id, text), rid of later windows."""
    seen, out = set(), {}
    for i, text in sorted({(r.doc_id, r.text) for r in rows}):
        lines = text.split("\n")
        at = [k for k, line in enumerate(lines) if line.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for j in range(len(at) - 2):
            window = tuple(lines[k] for k in at[j : j + 3])
            if window in seen:
                gone |= set(at[j : j + 3])
            seen.add(window)
        out[i, text] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return out


def brute_alike(texts, least=0.8, size=5):
    """Pairs of ids whose sets of `size` words have the similarity `least`, by comparing all that share a shingle."""
    sets, holders = {}, defaultdict(list)
    for i, text in texts.items():
        words = [w.lower() if w.isascii() else w.encode().lower().decode() for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        for s in sets[i]:
            holders[s].append(i)
    pairs = {(a, b) for ids in holders.values() for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :]}
    empty = sorted(i for i, s in sets.items() if not s)
    return [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])] + [(empty[0], i) for i in empty[1:]]


def test_groups_of_near_copies_keep_one(spark, monkeypatch):
    """Hundreds of edited copies, a chain, a common passage in unlike texts, and odd rows, against all pairs."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=4))
    base, rows = [word() for _ in range(200)], []
    passage = [word() for _ in range(60)]
    for i in range(260):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(0, 5)):
            words[at] = word()
        rows.append(" ".join(words))
    for i in range(80):
        own = [word() for _ in range(rng.randint(20, 90))]
        rows.append(" ".join(own[:10] + passage + own[10:]))
    chain = [word() for _ in range(150)]
    for i in range(12):
        chain[i * 12] = word()
        rows.append(" ".join(chain))
    rows += ["", "  ", None, "one two", "one two", "One TWO", rows[3], rows[-1].upper()]
    texts = dict(enumerate(rows))
    links = [*brute_alike(texts), *[(a, b) for a in texts for b in range(a + 1, len(rows)) if (brute_print(rows[a], 5) ^ brute_print(rows[b], 5)).bit_count() <= 4]]
    want = sorted(set(groups(list(texts), links).values()))
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(table).collect()) == want
    # equal rows, more marks to go than are broadcast, and many packs, merged in several rounds
    twice, plain = table.union(table.where("doc_id % 7 = 0")), simhash._only_kept
    monkeypatch.setattr(simhash, "_only_kept", lambda *args: plain(*args, few=0))
    for name, value in (("A_PACK", 500), ("A_PART", 4000), ("MEET", 4)):
        monkeypatch.setattr(shared_shingles, name, value)
    assert sorted(r.doc_id for r in simhash.representatives(twice).collect()) == want and 100 < len(want) < len(rows) - 200


def test_stages_against_brute_force(spark, tmp_path):
    docs, results = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert k == len(cp.STAGES) - 1 or out.columns == cp.COLUMNS
        results.append((docs.collect(), out.collect()))
        docs = out
    before, kept = results[0]
    rules = decision_list.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    verdicts = {r.doc_id: r.kept for r in decision_list.apply_rules(spark.read.parquet(f"{DATA}/documents.parquet"), rules).collect()}
    assert {r.doc_id for r in kept} == {i for i, v in verdicts.items() if v} and len(kept) < len(before)
    for r in kept:
        n, _, _, _, repeated = brute_stats(r.text)
        assert n >= 10 and 100 * repeated <= 20 * n
    before, lined = results[1]
    want = brute_lines(before)
    assert {r.doc_id: r.text for r in lined} == {i: t for (i, _), t in want.items()} and all(r.n_chars == len(r.text) for r in lined)
    before, single = results[2]
    prints, ids = {r.doc_id: brute_print(r.text, 5) for r in before}, sorted(r.doc_id for r in before)
    alike = brute_alike({r.doc_id: r.text for r in before})
    roots = groups(ids, [*alike, *[(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]])
    assert len(alike) > 5
    assert sorted(r.doc_id for r in single) == sorted(set(roots.values()))
    before, mixed = results[3]
    copies = {r.doc_id: r.copies for r in mixing.planned(spark.createDataFrame(before)).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: c for i, c in copies.items() if c})
    before, encoded = results[4]
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in before)
    assert len(cp.run(spark, DATA).collect()) == len(encoded)


def test_stages_take_odd_and_empty_tables(spark):
    for rows in (ODD, []):
        for _, stage in cp.STAGES:
            out = stage(spark, spark.createDataFrame(rows, DOC), DATA).collect()
            assert len(out) <= 2 * len(rows)
            ids = Counter(r.doc_id for r in out)
            if not rows:
                assert not out
            elif stage in (cp.line_dedup_stage, cp.encode_tokens):
                assert ids == Counter(r[0] for r in rows)
            elif stage is cp.simhash_dedup:
                # the empty texts are one group, every other text stands for itself
                assert ids == {1: 1, None: 2, 6: 1, 7: 2, 8: 1}
            elif stage is cp.quality_rules:
                assert set(ids) <= {7, 8}
