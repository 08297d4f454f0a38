"""Operators against plain versions, exact round trips or held-out accuracy, on the smallest test tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from conftest import SF_DIR

from varve.llm import components, ctw, decontaminate, fingerprints, language, licenses, mixing, neardup, quality, queries, sharding, textbytes, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOWN = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return WORD.findall((text or "").translate(DOWN))


def shingles(text, size):
    w = plain_words(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def groups(texts, size, num, den):
    """Smallest id reachable over all pairs of the given (id, text)."""
    sets = {i: shingles(t, size) for i, t in texts}
    holders, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders.get(s, ()))
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return queries.documents(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.collect())


def held_out(doc_id, n, rest):
    return zlib.crc32(str(doc_id).encode()) % n == rest


def test_words_and_shingles_match_plain_ones(texts):
    sample = [t for _, t in texts[:50]] + [None, "", "  ", "a", "A\tb", "É É"]
    seen, at = {}, 0
    for slab in textbytes.slabs(pa.array(sample), 4096):
        w = textbytes.words(slab)
        hashes, bounds = textbytes.shingle_hashes(textbytes.word_hashes(w), w.bounds, 3)
        for i in range(slab.rows):
            own = plain_words(sample[at])
            assert [bytes(w.low[a:b]).decode() for a, b in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]])] == own
            runs = [tuple(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
            assert len(runs) == bounds[i + 1] - bounds[i]
            for run, h in zip(runs, hashes[bounds[i] : bounds[i + 1]]):
                assert seen.setdefault(run, h) == h
            at += 1
    assert at == len(sample) and len(set(seen.values())) == len(seen)


def test_quality_on_held_out_labels(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality_scores(queries.documents(spark, sf), labels)
    joined = scored.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in joined) / len(joined) > 0.9


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = quality.Network.new(3)
    data = rng.integers(97, 105, 1500).astype(np.uint8)
    offsets, y = np.array([0, 3, 700, 1500]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(net.scores(data, offsets)) + (1 - y) * np.log(1 - net.scores(data, offsets)))
    for w, g in zip(net.weights, quality._gradients(net, data, offsets, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = w[at], 1e-2
        w[at] = keep + step
        up = loss()
        w[at] = keep - step
        down = loss()
        w[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=1e-3)


def test_a_text_scores_alike_alone_and_in_a_batch(texts):
    net = quality.Network.new(1)
    raw = [t.encode() for _, t in texts[:20]] + [b"", b"x" * 70_000]
    together = net.scores(np.frombuffer(b"".join(raw), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    alone = [net.scores(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]))[0] for x in raw]
    assert together == pytest.approx(alone, abs=1e-5)


def test_piece_pattern_agrees_with_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    pattern, odd = regex.compile(public_tokenizers.PATTERN), regex.compile(f"[^{tokens.AGREED}]")
    for c in map(chr, [*range(0x10000), *range(0x1F000, 0x20000)]):
        if not 0xD800 <= ord(c) < 0xE000 and not odd.match(c):
            text = f"a{c}b {c} 1{c}2"
            assert [text[x:y] for _, (x, y) in library.pre_tokenize_str(text)] == pattern.findall(text)


def test_token_counts_match_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in queries.op2_token_counts(spark, SF_DIR).collect()}
    assert got == {i: len(library.encode(t or "", add_special_tokens=False)) for i, t in texts}


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    sf = SF_DIR.replace("0.001", "0.1")
    first = queries.op3_source_mix(spark, sf).collect()
    taken, target = Counter(), {}
    for r in first:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in first))
    assert all(abs(taken[s] - t) < 0.1 * t for s, t in target.items())
    assert sorted(map(tuple, first)) == sorted(map(tuple, queries.op3_source_mix(spark, sf).collect()))


def test_mixed_documents_follow_the_counts(docs):
    copies = Counter(r.doc_id for r in mixing.mix_documents(docs).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in mixing.mix_counts(docs).collect())


def test_base_score_matches_a_plain_count(spark, texts):
    tok = {i: [*plain_words(t), None] for i, t in texts}
    counts = Counter(w for i, ws in tok.items() if not held_out(i, 5, 1) for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in ctw.scores(queries.documents(spark, SF_DIR), max_words=2000).collect()}
    for i, ws in tok.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert got[i].base_score == pytest.approx(base)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, held_out(i, 5, 1))


def plain_tree(texts):
    """The context tree's weights, one node at a time."""
    nodes = {}
    for t in texts:
        data = bytes([ctw.END]) * ctw.DEPTH + " ".join(plain_words(t)).encode() + bytes([ctw.END])
        for p in range(ctw.DEPTH, len(data)):
            node = 1
            for k in range(8):
                bit = data[p] >> (7 - k) & 1
                for d in range(ctw.DEPTH + 1):
                    nodes.setdefault((d, data[p - d : p], node), [0, 0])[bit] += 1
                node = 2 * node + bit
    lg = math.lgamma
    own = {k: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi) for k, (a, b) in nodes.items()}
    mixed, longer = {}, Counter()
    for d in range(ctw.DEPTH, -1, -1):
        for k in [k for k in nodes if k[0] == d]:
            mixed[k] = own[k] if d == ctw.DEPTH else math.log(0.5) + np.logaddexp(own[k], longer[k])
            if d:
                longer[d - 1, k[1][1:], k[2]] += mixed[k]
    return nodes, {k: own[k] - longer[k] for k in nodes}


def test_context_tree_matches_a_plain_one(spark):
    texts = ["abab abab", "abba aab", "ab ab ab", "b"]
    nodes, beta = plain_tree(texts)
    counts = ctw.counted(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {}
    for r in ctw.tree(counts.where(f"kind = {ctw.GRAM}")).collect():
        got[r.depth, r.context.to_bytes(8, "little")[: r.depth][::-1], r.node] = ([r.n0, r.n1], r.beta)
    assert got.keys() == nodes.keys()
    for k, (n, b) in got.items():
        assert n == nodes[k] and (k[0] == ctw.DEPTH or b == pytest.approx(beta[k], abs=1e-3))


def test_predictions_sum_to_one(spark):
    counts = ctw.counted(spark.createDataFrame([("hello there hallo",), ("here and there",)], "text string"))
    model = ctw.fit(spark, counts, 1 << 16, 100)
    for context in (b"hello", b"\n\n\n\n\n", b"zzzzz", b" ther"):
        high = np.uint64(int.from_bytes(context, "big") << 8)
        assert np.exp2(model.log2(high | np.arange(256, dtype=np.uint64)).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_context_tree_scores_do_not_depend_on_the_broadcast_part(spark, texts):
    docs = queries.documents(spark, SF_DIR).limit(60)
    docs = docs.unionByName(docs.limit(5)).cache()
    whole = sorted((r.doc_id, r.score) for r in ctw.scores(docs).collect())
    for limit in (0, 300, 20_000):
        cut = sorted((r.doc_id, r.score) for r in ctw.scores(docs, max_nodes=limit, max_words=100).collect())
        assert [i for i, _ in cut] == [i for i, _ in whole]
        assert [s for _, s in cut] == pytest.approx([s for _, s in whole], rel=1e-5)


def test_context_tree_beats_the_words_on_held_out_texts(spark):
    got = queries.op4_context_tree(spark, SF_DIR.replace("0.001", "0.1")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_wand_retrieves_all_and_only_items_over_the_threshold():
    rng = random.Random(4)
    postings = []
    for _ in range(60):
        own = sorted(rng.sample(range(700), rng.randint(1, 400)))
        impact = [rng.random() * 0.2 for _ in own]
        cuts = range(0, len(own), decontaminate.BLOCK)
        postings.append(decontaminate.Posting(own, impact, [own[min(c + decontaminate.BLOCK, len(own)) - 1] for c in cuts], [max(impact[c : c + decontaminate.BLOCK]) for c in cuts], max(impact)))
    index = decontaminate.Index(np.zeros(0), postings, np.zeros(0), None, [], [], [], 1)
    for threshold in (0.5, 1.0, 2.0, 3.5):
        terms = sorted(rng.sample(range(60), 40))
        sums = Counter()
        for t in terms:
            for i, x in zip(postings[t].items, postings[t].impacts):
                sums[i] += x
        want = {i: s for i, s in sums.items() if s >= threshold}
        assert dict(index.retrieve(terms, threshold)) == pytest.approx(want)


def test_every_verbatim_item_is_found_and_clean_texts_stay(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    norm = lambda t: f" {' '.join(plain_words(t))} "
    documents = [(r.doc_id, norm(r.text)) for r in queries.documents(spark, sf).collect()]
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for i, t in items for d, x in documents if t in x}
    found = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, sf).collect()}
    assert want <= found
    body, runs = dict(documents), {i: shingles(t, 5) for i, t in items}
    assert all(len(runs[i] & shingles(body[d], 5)) >= 0.5 * len(runs[i]) for d, i in found)


@pytest.mark.parametrize(("size", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near_duplicates_match_all_pairs(docs, texts, size, num, den):
    component, sizes = groups(texts, size, num, den)
    got = neardup.near_duplicates(docs, size, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (sizes[i], c, c == i) for i, c in component.items()}
    assert {r.doc_id for r in neardup.keep_one(docs, size, num, den).collect()} == {i for i, c in component.items() if c == i}


def test_large_groups_of_copies_lose_no_link(spark):
    """Random edits of a few texts: many pairs lie close to the limit, lists are long and sets longer than a sketch."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for length, n in ((110, 150), (420, 120)):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randint(0, length // 14)):
                own[rng.randrange(length)] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [" ".join(passage + [rng.choice(vocabulary) for _ in range(80)]) for _ in range(150)]
    rng.shuffle(rows)
    numbered = list(enumerate(rows))
    want, _ = groups(numbered, 3, 85, 100)
    got = neardup.near_duplicates(spark.createDataFrame(numbered, "doc_id long, text string"), 3, 85, 100)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    links = [*chain, *[(7, k) for k in range(8, 40)], (3, 3), (8, 7), (90, 95), (95, 80)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 7 for k in range(7, 40)}, 80: 80, 90: 80, 95: 80}


def test_shards_hold_every_row_once(docs, texts):
    shards = sharding.shuffle_to_shards(docs, shards=7).collect()
    assert sorted((r.doc_id, r.text) for r in shards) == texts
    in_order = [r.doc_id for r in sorted(shards, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(in_order, range(len(in_order)))[0, 1]) < 0.25


def test_edited_notices_are_found_with_their_spans(spark):
    notice = licenses.TEMPLATES["Apache-2.0"]
    body = "Some words here. LICENSED under the  Apache Licence, version 2.0! And more, Release under the MIT License. End"
    rows = licenses.license_matches(spark.createDataFrame([(1, body), (2, "Licensed under the stars")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in rows] == [(1, "Apache-2.0"), (1, "MIT")]
    assert body.encode()[rows[0].span_start : rows[0].span_end].decode() == "LICENSED under the  Apache Licence, version 2.0"
    assert 0.9 <= rows[0].coverage < 1 and len(notice) > 0


def test_notices_match_a_plain_search(spark, texts):
    sf = SF_DIR.replace("0.001", "0.01")
    squeeze = lambda t: re.sub("[^0-9a-z\x80-\U0010ffff]", "", t.translate(DOWN))
    found = Counter(r.license for r in queries.op8_licenses(spark, sf).collect())
    body = [squeeze(r.text) for r in queries.documents(spark, sf).collect()]
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "all-rights-reserved"):
        assert found[name] == sum(t.count(squeeze(licenses.TEMPLATES[name])) for t in body)


def test_edited_texts_and_fingerprints(spark, texts):
    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, SF_DIR).collect()}
    for k, (i, t) in enumerate(texts):
        following, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
    assert sum(r.near_edited for r in got.values()) > 10 * sum(r.near_next for r in got.values())


def test_fingerprints_merge_and_estimate_containment(spark):
    from pyspark.sql import functions as F

    words = [f"t{k}" for k in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:1000])), (3, " ".join(words[1000:]))]
    prints = spark.createDataFrame(rows, "id long, text string").select("id", fingerprints.fingerprint(F.col("text")).alias("p")).cache()
    by_id = {r.id: r.p for r in prints.collect()}
    assert set(by_id[2]) <= set(by_id[1])
    assert len(by_id[1]) == pytest.approx(4000 / fingerprints.SCALE, rel=0.15)
    both = prints.where("id > 1").agg(fingerprints.merged(F.collect_list("p")).alias("p")).first().p
    assert set(both) <= set(by_id[1]) and len(set(by_id[1]) - set(both)) <= 4


def test_language_on_held_out_texts(spark):
    sf = SF_DIR.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in queries.documents(spark, sf).collect()}
    got = [r for r in queries.op10_language(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.98


def test_presence_rows_match_plain_ones(texts):
    sample = [t for _, t in texts[:8]] + ["", "a", "ab"]
    (slab,) = textbytes.slabs(pa.array(sample))
    grams = language.Grams.of(slab.data)
    seen = grams.presence(slab, 0, len(sample)).sum(axis=1)
    for t, n in zip(sample, seen):
        raw = re.sub(rb"[\t-\r]", b" ", t.translate(DOWN).encode())
        assert n == sum(len({raw[k : k + m] for k in range(len(raw) - m + 1)}) for m in (1, 2, 3))
