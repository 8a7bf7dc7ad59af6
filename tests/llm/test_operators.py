"""Each operator against a plain version of its rules, on small rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliant.llm import components, exact_dedup, kernels, license_scan, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, secret_scan, token_counts
from foliant.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, token string, row long, size long, n_shingles long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = prose(rng, 120)
    w = base.split()
    near = " ".join([*w[:60], "changed", *w[61:]])
    shared = "\n".join(prose(rng, 12) for _ in range(30))
    texts = [None, "", " \n\t ", "one two", "One TWO", base, base, near, near.upper(), prose(rng, 300), prose(rng, 6000), "x" * 30_000, "same same " * 300, "a\n" + shared + "\nb", shared + "\nlast line"]
    texts += ['token = "0123456789abcdef0123456789abcdef" user: anna', "AKIA" + "A1B2C3D4E5F6G7H8" + " password=hunter22", "Licensed under the Apache License, Version 2.0.\nplain line", "<|endoftext|> a<|endoftext|>b", "été déjà vu 漢字 🙂 İΣß"]
    texts += ["HEAD!! SHOUT!! " * 40, "a | b | c | d | e | f\n" * 12, "sym*** bol### word$$$ " * 30]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    rows = [(i, t, None if i % 11 == 0 else "en", None if i % 7 == 0 else f"s{min(i % 5, 2)}", None, True, 1, "t", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[9]]  # repeated rows
    rows += [(None, "without an id", None, None, None, None, None, None, None, None, None), (None, base, "en", "s1", 0, True, 1, "t", 2, 3, 4)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i in (12, 20, 21, 22) else 1) for i in range(9, 50)] + [(None, 1), (9, None)], "doc_id long, quality int")


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def test_no_rows(spark, nothing, labels):
    for out in (
        near_dedup.near_dedup(nothing), mixing.plan_mix(nothing), mixing.mix(nothing), token_counts.token_counts(nothing, public_tokenizers.path("byte_bpe_50k.json")), line_dedup.line_dedup(nothing), license_scan.license_scan(nothing),
        quality_rules.quality_rules(nothing), exact_dedup.exact_dedup(nothing), secret_scan.secret_scan(nothing), packing.pack(nothing, public_tokenizers.path("word_bpe_49k.json")), quality_classifier.quality_classifier(nothing, labels),
    ):
        assert out.count() == 0


def shingle_set(text):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = WORD.findall((text or "").translate(fold))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(list)
    for (i, _), g in zip(rows, group):
        least[g] += [] if i is None else [i]
    want = [(i, len(s), min(least[g], default=None) if s else i) for (i, _), s, g in zip(rows, sets, group)]
    got = near_dedup.near_dedup(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_of_a_large_group(spark):
    """Copies of one text with up to nine words changed, some within reach of each other alone."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = []
    for i in range(250):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(0, 9)):
            w[at] = prose(rng, 1) + str(i % 120)
        rows.append((i, " ".join(w)))
    far = rows[7][1].split()
    far[3], far[90] = "solo", "only"
    rows.append((900, " ".join(far)))
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    assert 1 < len(set(group)) < 200
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: least[g] for (i, _), g in zip(rows, group)}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    roots = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    parent = {x: x for link in links for x in link}
    for _ in range(300):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {x: roots.get(x, x) for x in parent} == parent


def plain_targets(sizes, weights, cap=3.0):
    """Share, cap those above, share again."""
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in sizes if s not in fixed]
        target = {**fixed, **{s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}}
        above = {s: cap * sizes[s] for s in open_ if target[s] > cap * sizes[s] * (1 + 1e-12)}
        if not above:
            return {s: target[s] for s in sizes}
        fixed |= above


def test_source_targets():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 12)
        sizes, weights = [rng.choice([0, 1, 5, rng.randint(1, 1000)]) for _ in range(n)], [rng.choice([5, 2, 1]) for _ in range(n)]
        assert mixing.source_targets(sizes, weights) == pytest.approx(list(plain_targets(dict(enumerate(sizes)), weights).values()))
    assert mixing.source_targets([], []) == []


@pytest.mark.parametrize("cap, weights_", [(3.0, (5, 2, 1)), (50.0, (1, 200, 1))])
def test_mixing(docs, cap, weights_):
    """Blocks, stops, quotas and taken words, worked out again from the rows' places."""
    rows = [r for r in mixing.plan_mix(docs, weights_, cap, shards=8, blocks=50).collect()]
    again = [r for r in mixing.plan_mix(docs.repartition(5), weights_, cap, shards=8, blocks=50).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again))
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = plain_targets({s: sizes[s] for s in order}, {s: weights_[i % 3] for i, s in enumerate(order)}, cap)
    largest, shard_of = max(r.size for r in rows), {}
    for s in order:
        own = [r for r in rows if r.source == s]
        blocks = max(1, round(50 * sizes[s] / sum(sizes.values())))
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= largest
        full, rest = divmod(target[s], sizes[s]) if sizes[s] else (0, 0)
        at, stop = 0, -1
        for place, words in sorted(Counter({p: sum(r.size for r in own if r.place == p) for p in {r.place for r in own}}).items()):
            if words and at + words / 2 <= rest:
                stop = place
            at += words
        for r in own:
            assert r.block == ((r.place >> 32) * blocks) >> 31
            want = range(int(full) + (r.place <= stop)) if r.size else []
            assert [d.epoch for d in r.draws] == list(want) and r.taken == r.size * len(r.draws)
            for d in r.draws:  # a block goes to one shard in an epoch
                assert shard_of.setdefault((s, r.block, d.epoch), d.shard) == d.shard
    assert len(set(shard_of.values())) == 8
    if cap > 3:
        assert max(len(r.draws) for r in rows) > 8  # more epochs than any fixed list would hold


def plain_tree(quotas, first, last, node, seed):
    """The blocks of each shard by recursion."""
    if last - first == 1:
        return [quotas]
    mid = (first + last) // 2
    have = [i for i, q in enumerate(quotas) if q]
    rng = np.random.Generator(np.random.PCG64([seed, node]))
    drawn = rng.multivariate_hypergeometric([quotas[i] for i in have], sum(quotas) * (mid - first) // (last - first), method="marginals") if have else []
    left = [0] * len(quotas)
    for i, n in zip(have, drawn):
        left[i] = int(n)
    return plain_tree(left, first, mid, 2 * node, seed) + plain_tree([q - x for q, x in zip(quotas, left)], mid, last, 2 * node + 1, seed)


def test_dealt_blocks(spark):
    """Every quota is dealt exactly, each draw once, in the tree's counts, above and below the driver's nodes."""
    import pandas as pd

    plan = pd.DataFrame({"skey": [5, -7, 0, 9], "blocks": [400, 10, 3, 111], "quota": [1000, 10, 0, 333], "stop": [12, -1, -1, 5]})
    for shards in (1, 7, 600):
        dealt = mixing.dealt_blocks(spark, plan, shards, 5).collect()
        for r in plan.itertuples():
            own = [d for d in dealt if d.skey == r.skey]
            assert sorted(d.epoch * r.blocks + d.block for d in own) == list(range(r.quota))
            assert {d.epoch * r.blocks + d.block for d in own if d.stop < 2**62} == ({r.quota - 1} if r.stop >= 0 else set())
        count = Counter((d.shard, d.skey) for d in dealt)
        want = plain_tree(plan.quota.tolist(), 0, shards, 1, 5)
        assert count == Counter({(k, s): n for k, own in enumerate(want) for s, n in zip(plan.skey.tolist(), own) if n})
        assert np.ptp([sum(own) for own in want]) <= 11


def test_mix_rows(docs):
    for cap, weights in ((3.0, (5, 2, 1)), (50.0, (1, 200, 1))):
        planned = mixing.plan_mix(docs, weights, cap, shards=4, blocks=20).collect()
        drawn = mixing.mix(docs, weights, cap, shards=4, blocks=20).collect()
        draws = Counter((r.doc_id, d.epoch, d.shard) for r in planned for d in r.draws)
        assert Counter((r.doc_id, r.epoch, r.shard) for r in drawn) == draws
        assert sum(len(WORD.findall(r.row.text)) for r in drawn) == sum(r.taken for r in planned)


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(docs, name):
    t = tokenizer(name)
    want = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    got = token_counts.token_counts(docs, public_tokenizers.path(name)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_parts_cover_texts_in_small_blocks():
    import pyarrow as pa

    texts = pa.array(["", "ab cd, ef", "x" * 500, None, "é è  ê\nz", " lead", "don't 's"])
    buf, offsets = kernels.buffers(texts)
    for block in (4, 16, 1 << 20):
        at = 0
        for starts, ends, _ in kernels.parts(buf, offsets, block):
            assert starts[0] == at and (starts[1:] == ends[:-1]).all()
            at = ends[-1]
        assert at == len(buf)


def test_parts_are_found_without_hashing(monkeypatch):
    """np.union1d hashes every place and took a third of a tokenizer's CPU time; the places are the safe ones and the texts' starts."""
    import pyarrow as pa

    buf, offsets = kernels.buffers(pa.array(["", "ab cd, ef", None, " lead", "x", "don't 's  é è"]))
    want = sorted({0, *kernels.safe_cuts(buf, 0).tolist(), *offsets[:-1][np.diff(offsets) > 0].tolist()})

    def hashed(*a, **k):
        raise AssertionError("places are hashed")

    monkeypatch.setattr(np, "union1d", hashed)
    monkeypatch.setattr(np, "unique", hashed)
    (starts, ends, texts), = kernels.parts(buf, offsets)
    assert starts.tolist() == want and ends.tolist() == [*want[1:], len(buf)]
    assert texts.tolist() == [max(t for t in range(len(offsets) - 1) if offsets[t] <= at) for at in want]


def test_packing(docs):
    t = tokenizer("word_bpe_49k.json")
    want = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want += [(r.doc_id, k, s, len(ids[s : s + 512]), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=512, per_partition=40).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 512
    assert len(bins) <= 1.05 * packing.lower_bound(np.array([w[3] for w in want]), 512) + 1


def test_packing_holds_few_texts_at_a_time(spark, monkeypatch):
    """A batch of 10,000 long texts is held by the executor and by its worker, beside all that earlier steps left there."""
    real, most = packing._pieces, 8 << 20

    def watched(*args):
        cut = real(*args)

        def small(batches):
            for batch in batches:
                if batch.nbytes > most:
                    raise AssertionError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return lambda batches: cut(small(batches))

    monkeypatch.setattr(packing, "_pieces", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('a b ', 500) AS text")
    assert packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).where("length = 1001").count() == 6000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize("seed", [0, 1])
def test_exchange_saves_bins(spark, seed):
    """Partitions miss their bounds, and the exchange takes fewer sequences than one round; null and very large ids stay as they are."""
    rng = np.random.default_rng(seed)
    rows = [(2**60 + k if k % 7 else None, " ".join(["the"] * int(n))) for k, n in enumerate(rng.integers(89, 259, 1200))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    taken = {}
    for rounds in (1, 3):
        got = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), window=410, per_partition=60, rounds=rounds).collect()
        assert sorted(((r.doc_id,) for r in got), key=key) == sorted(((r[0],) for r in rows), key=key)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= 410
        taken[rounds] = len(bins)
    assert packing.lower_bound(np.array([r.length for r in got]), 410) <= taken[3] < taken[1]


def test_lower_bound_against_all_packings():
    def least(sizes, room=()):
        if not sizes:
            return len(room)
        ways = [least(sizes[1:], (*room[:k], left - sizes[0], *room[k + 1 :])) for k, left in enumerate(room) if left >= sizes[0]]
        return min([*ways, least(sizes[1:], (*room, 12 - sizes[0]))])

    rng = np.random.default_rng(1)
    tight = 0
    for _ in range(150):
        sizes = rng.integers(1, 13, rng.integers(1, 8))
        bound, want = packing.lower_bound(sizes, 12), least(tuple(sizes.tolist()))
        assert bound <= want
        tight += bound == want
    assert tight >= 130


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        place, offset, room = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(room) <= 1.3 * packing.lower_bound(lengths, 100) + 1
        assert (np.bincount(place, lengths) + room == 100).all()
    assert packing.lower_bound(np.array([51, 51, 51]), 100) == 3


def test_exact_dedup(spark, docs):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(docs, keep=keep).collect()
        want = [(r.doc_id, pick([i for i in groups[r.text or ""] if i is not None], default=None), len(groups[r.text or ""]), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows]
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
        kept = Counter(r.text_sha256 for r in got if r.kept)
        assert len(kept) == len(groups) and set(kept.values()) == {1}


@pytest.mark.parametrize("keep, stays", [("largest", (1998, 1999)), ("smallest", (0, 1))])
def test_exact_dedup_of_hot_texts(spark, keep, stays):
    """Two groups are salted over many parts (67 and 27), and their parts' results merged."""
    rows = spark.range(2000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 AND id % 2 = 1 THEN repeat('warm', 10) ELSE concat('t', id) END AS text")
    got = exact_dedup.exact_dedup(rows, keep=keep, part_bytes=1000).collect()
    groups = defaultdict(list)
    for i in range(2000):
        groups["hot" if i % 3 == 0 else "warm" * 10 if i % 3 == 1 and i % 2 == 1 else f"t{i}"].append(i)
    pick = max if keep == "largest" else min
    want = [(i, pick(own), len(own), i == pick(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for i in own]
    assert sorted(map(tuple, got)) == sorted(want) and {pick(groups["hot"]), pick(groups["warm" * 10])} == set(stays)


def test_exact_dedup_of_texts_with_one_prefix(spark):
    rows = [(i, "the same first characters " + "x" * (i % 7)) for i in range(100)] + [(None, "the same first characters ")] * 3
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.kept) == list(range(7)) and Counter(r.group_size for r in got)[15 + 3] == 18


def plain_chunks(text):
    lines, long = text.split("\n"), line_dedup.LONG_LINE
    hashes = [hashlib.md5(x.encode()).hexdigest() if len(x) < long else None for x in lines]
    out = [[]]
    for i, line in enumerate(lines):
        out[-1].append(line)
        if i == len(lines) - 1:
            break
        inner = i > 0 and hashes[i] is not None and all(h is None or hashes[i] < h for h in (hashes[i - 1], hashes[i + 1]))
        if hashes[i] is None or hashes[i + 1] is None or inner:
            out.append([])
    return out


def plain_line_dedup(rows):
    """(doc_id, n_lines, removed chunks, removed lines, clean text) of (doc_id, text), by a walk over all rows in order."""

    def place(row):
        return (row[0] is not None, row[0] or 0, hashlib.md5((row[1] or "").encode()).hexdigest())

    seen, done = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=place):
        left, gone = [], []
        for c in plain_chunks(text):
            whole = "\n".join(c)
            if (len(c) >= line_dedup.LEAST_LINES and len(whole) >= line_dedup.LEAST_CHARS) or len(whole) >= line_dedup.LONG_LINE:
                if whole in seen:
                    gone.append(c)
                    continue
                seen.add(whole)
            left.append(whole)
        done[i, text] = (i, text.count("\n") + 1, len(gone), sum(map(len, gone)), "\n".join(left))
    return [done[i, t or ""] for i, t in rows]


def test_line_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(12)
    lines = [prose(rng, rng.randint(1, 20)) for _ in range(40)] + [prose(rng, 90) for _ in range(4)] + ["", "\u0001b", "\u0001"]
    rows += [(1000 + i, "\n".join(rng.choice(lines[k : k + 9]) for k in range(rng.randint(0, 9), rng.randint(1, 40)))) for i in range(120)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_line_dedup(rows), key=key) and sum(r.n_removed_chunks for r in got) > 20


def planted(rng, n_lines, n_words):
    """Two texts that share a passage of so many lines and words between lines of their own."""
    own = lambda: [prose(rng, rng.randint(8, 60)) for _ in range(rng.randint(2, 6))]
    cuts = sorted(rng.sample(range(1, n_words), n_lines - 1))
    words = prose(rng, n_words).split()
    passage = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, n_words])]
    return ["\n".join(own() + passage + own()) for _ in range(2)], passage


def test_planted_passages(spark):
    """Recall on passages that stand in two texts: a passage on one long line always goes; of several short lines the inner ones do."""
    rng = random.Random(21)
    share = {}
    for n_lines, n_words in ((1, 120), (8, 120), (20, 240)):
        texts = [planted(rng, n_lines, n_words) for _ in range(60)]
        rows = [(2 * i + j, pair[j]) for i, (pair, _) in enumerate(texts) for j in (0, 1)]
        got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(got[2 * i].clean_text == pair[0] for i, (pair, _) in enumerate(texts))  # first copies stay whole
        share[n_lines] = sum(got[2 * i + 1].n_removed_lines for i in range(60)) / (60 * n_lines)
    assert share[1] == 1 and share[8] > 0.4 and share[20] > 0.7


def plain_license(text):
    """(paragraphs, found notices, families, unknown notices) by loops over all runs of lines, with or without a gate word."""
    L = license_scan
    classes, vocabulary, weights, temperature = L.train()
    index = {g: i for i, g in enumerate(vocabulary)}
    lines = (text or "").split("\n")
    span = max(len(L.words(t)) for texts in L.TEMPLATES.values() for t in texts)
    found = []
    for k in range(len(lines)):
        for last in range(k, min(len(lines), k + span + 2)):
            run = lines[k : last + 1]
            if not all(WORD.search(x) for x in run) or sum(len(L.words(x)) for x in run[1:-1]) > span:
                continue
            have = L.grams(" ".join(run))
            if not have & set(index):
                continue
            z = np.round((weights[-1] + sum(weights[index[g]] for g in have if g in index)) / temperature, 9)
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            for c, prob in zip(classes, p):
                best = c == classes[int(np.argmax(z))]
                stated = [{cue} for cue in L.CUES] if c == L.UNKNOWN else [L.pairs(t) for t in L.TEMPLATES.get(c, [])]
                if (best or (c not in (L.UNKNOWN, L.NONE) and round(prob, 6) >= L.ALONGSIDE)) and any(len(have & t) >= L.CONFIRMED * len(t) for t in stated):
                    found.append((c, k, last))
    known = [(k, e) for c, k, e in found if c != L.UNKNOWN]
    found = [(c, k, e) for c, k, e in found if c != L.UNKNOWN or not any(k <= b and e >= a for a, b in known)]
    found = [(c, k, e) for c, k, e in found if not any(c == d and (k, e) != (a, b) and k <= a and b <= e for d, a, b in found)]
    starts = Counter()
    for c in {c for c, _, _ in found}:
        own = sorted((k, e) for d, k, e in found if d == c)
        starts[c == L.UNKNOWN] += sum(i == 0 or own[i][0] > own[i - 1][1] for i in range(len(own)))
    paragraphs = sum(bool(WORD.search(x)) and (i == 0 or not WORD.search(lines[i - 1])) for i, x in enumerate(lines))
    return paragraphs, starts[False], ",".join(sorted({c for c, _, _ in found} - {L.UNKNOWN})), starts[True]


def license_rows(spark, texts):
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.n_paragraphs, r.n_license_paragraphs, r.families, r.n_unknown_paragraphs) for r in got}


def test_license_scan(spark, docs):
    got = license_scan.license_scan(docs).collect()
    want = [(r.doc_id, *plain_license(r.text)) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_paragraphs, r.n_license_paragraphs, r.families, r.n_unknown_paragraphs) for r in got), key=key) == sorted(want, key=key)
    assert any(r.families == "apache-2.0" for r in got)
    rng = random.Random(17)
    stated = [t for texts in license_scan.TEMPLATES.values() for t in texts] + list(license_scan.OTHERS) + [f.format(n) for n in license_scan.OTHER_NAMES[-5:] for f in license_scan.STATEMENTS] + ["", " ", "plain words"]
    texts = ["\n".join(" ".join(w + rng.choice(["", "", "", "", "\n"]) for w in rng.choice(stated).split(" ")) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    assert license_rows(spark, texts) == {i: plain_license(t) for i, t in enumerate(texts)}


def test_license_families(spark):
    stated = [(f, t + ".") for f, texts in license_scan.TEMPLATES.items() for t in texts if t != "MIT or Apache-2.0"] + [("", t) for t in license_scan.OTHERS]
    got = license_rows(spark, [t for _, t in stated])
    assert {i: r[2] for i, r in got.items()} == {i: f for i, (f, _) in enumerate(stated)} and not any(r[3] for r in got.values())


def test_headed_dual_and_unknown_licences(spark):
    """Headings, two licences at once, and licences of names that the fit hasn't seen; sentences without one aren't any."""
    said = ["MIT License\n\nCopyright 2020 A. Person", "Dual licensed: MIT or Apache-2.0", "Apache License\nVersion 2.0, January 2004"]
    assert [r[2] for _, r in sorted(license_rows(spark, said).items())] == ["mit", "apache-2.0,mit", "apache-2.0"]
    held = [f.format(n) for n in license_scan.OTHER_NAMES[-license_scan.HELD_NAMES :] for f in license_scan.STATEMENTS[1:]] + ["Licensed under the Orchard Tool License, version 7", "Eclipse Public License 2.0"]
    got = license_rows(spark, held)
    assert all(r[2] == "" for r in got.values()) and sum(r[3] == 1 for r in got.values()) >= 0.8 * sum(any(c in held[i].lower() for c in license_scan.CUES) for i in got)
    plain = [prose(random.Random(i), 40) + ". " + t for i, t in enumerate(license_scan.OTHERS)]
    assert not any(r[1] or r[3] for r in license_rows(spark, plain).values())


def test_license_gate_with_words_dropped(spark):
    """No run of a template's words that holds CONFIRMED of its pairs misses the gate, nor does a text of just these pairs."""
    rng = random.Random(4)
    for text in (t for texts in license_scan.TEMPLATES.values() for t in texts):
        w, stated = license_scan.words(text), sorted(license_scan.pairs(text))
        runs = [" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
        least = int(np.ceil(license_scan.CONFIRMED * len(stated)))
        runs += [" / ".join(rng.sample(stated, least)) for _ in range(200)]
        for run in runs:
            if len(license_scan.pairs(run) & set(stated)) >= least:
                assert re.search(license_scan.GATE, run), run
    first = "This Source Code Form is subject to the terms of the Mozilla Public"
    assert [r.families for r in license_scan.license_scan(spark.createDataFrame([(1, first)], "doc_id long, text string")).collect()] == ["mpl-2.0"]


def test_license_notices_over_several_lines(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."
    prose_ = "Some words of no weight stand here\n"
    texts = [
        ("apache-2.0", 1, "Licensed under the Apache License,\nVersion 2.0"), ("gpl-3.0", 1, gpl), ("gpl-3.0", 1, "/*\n * " + gpl.replace("\n", "\n * ") + "\n */"), ("gpl-3.0", 1, prose_ * 3 + gpl + "\n" + prose_ * 3),
        ("apache-2.0", 2, "Licensed under the Apache License, Version 2.0\nplain line\nLicensed under the\r\nApache License,\r\nVersion 2.0"), ("apache-2.0", 1, "Licensed under the Apache License,\n\nVersion 2.0"), ("", 0, "Permission is hereby granted, free of charge,\n\nto any person obtaining a copy of this software"), ("mit", 2, "Licensed under the MIT license\nLicensed under the MIT license"),
        ("apache-2.0,mit", 2, "Licensed under the MIT license\nLicensed under the Apache License, Version 2.0"), ("mit", 1, "\n".join("Permission is hereby granted, free of charge, to any person obtaining a copy of this software".split())), ("", 0, prose_ + "2 by 3"),
    ]
    got = license_scan.license_scan(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.families, r.n_license_paragraphs) for r in got} == {i: (f, n) for i, (f, n, _) in enumerate(texts)}


def test_quality_rules(docs):
    def plain(text):
        text = text or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        marked = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed

    got = quality_rules.quality_rules(docs).collect()
    measures = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[m] for m in measures) for r in got), key=key) == sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=key)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (20, 21, 22)) and kept[9] and kept[10]


def plain_line_fails(line):
    """The rules, by loops over characters."""
    q = quality_rules
    ends, closers, marks = (re.compile(f"[{c}]") for c in (q.SENTENCE_ENDS, q.CLOSERS, q.PUNCTUATION))
    n = len(line)
    bars, symbols, capitals = (sum(map(f, line)) for f in (lambda c: c in "|>»·•", lambda c: c in "#*$%&|<>", lambda c: unicodedata.category(c) == "Lu"))
    punctuation = sum(bool(marks.match(c)) for c in line)
    sentence = any(ends.match(c) and (i == n - 1 or closers.match(line[i + 1])) for i, c in enumerate(line))
    return (
        symbols > q.SYMBOL_SHARE * n or (bars >= q.NAV_MARKS and n <= q.NAV_CHARS * bars) or (capitals >= q.SHOUT_CAPITALS and capitals >= q.SHOUT_SHARE * n)
        or (punctuation >= q.PUNCTUATION_MARKS and punctuation >= q.PUNCTUATION_SHARE * n) or (bool(WORD.search(line)) and n <= q.FRAGMENT_CHARS and not sentence)
        or (n <= q.BOILERPLATE_CHARS and any(b in line.lower() for b in q.BOILERPLATE))
    )


def test_line_rules(spark):
    """Every line's verdict and what the document loses, against loops."""
    rng = random.Random(9)
    sentence = "It is a line of prose that goes on for some time, and ends as prose does."
    some = [sentence, "!!!! ???? ....", "Home", "About us", "Contact", "Ещё", "早く行きましょう。", "Wait...", 'He said "no."', "(It rained.)", "", "   ", "\r", "ends here.\r", "HEAD LINE IN CAPITALS", "a | b | c | d", "one > two > three > four", "Read more", "x" * 61, "x" * 60, "* item one", "50% off $$$ now", "- - - - -", "Überschrift", "What?", "note: this", "«Oui.»", "3.14", "e.g", "— — — —", "[1] [2] [3]"]
    texts = [sentence, "\n".join(f"Our products no{i} item{i}" for i in range(40)), "\n".join([sentence.replace(" ", f" w{i} ") for i in range(9)] + ["Home", "!!!! ???? ...."])]
    texts += ["\n".join(rng.choices(some, k=rng.randint(1, 12))) for _ in range(300)] + [x for x in some]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        lines = text.split("\n")
        failed = [x for x in lines if plain_line_fails(x)]
        lost = sum(map(len, failed))
        assert (got[i].n_failed_lines, got[i].lost_chars, got[i].clean_text) == (len(failed), lost, "\n".join(x for x in lines if not plain_line_fails(x))), text
        assert got[i].kept == (not got[i].base_failed and lost <= quality_rules.LOST_SHARE * sum(map(len, lines)))
    assert got[1].n_failed_lines == 40 and not got[1].kept and got[2].n_failed_lines == 2 and got[2].kept


def test_secret_scan(docs):
    patterns = (("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))

    def plain(text):
        spans = []
        for k, (kind, pattern, least) in enumerate(patterns):
            for m in re.finditer(pattern, text or ""):
                if len(m[2] if kind == "assign" else m[0]) >= least:
                    spans.append((m.start(), k, m.end(), kind))
        digest = hashlib.sha256(",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans)).encode()).hexdigest()
        return (*[sum(x[3] == kind for x in spans) for kind, _, _ in patterns], digest)

    got = secret_scan.secret_scan(docs).collect()
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=key) == sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=key)
    assert next(r for r in got if r.doc_id == 15).spans.endswith("id:43:53")  # the user beside a secret


def test_suspects_hold_every_text_with_a_span():
    import pyarrow as pa

    rng = random.Random(6)
    some = ["the end", "", None, "0123456789abcdef01234567", "ab", "é", "password=hunter22", "AKIA" + "A1" * 8, "user: anna", "Ab1" * 12, "see 10.0.0.1", "http://a.example", "plain"]
    batches = [["the end", "", "0123456789abcdef01234567"], ["bad", None, "", "c0de" * 6, "x"], [], ["", None]] + [rng.choices(some, k=rng.randint(1, 9)) for _ in range(400)]
    for texts in batches:
        buf, offsets = kernels.buffers(pa.array(texts, pa.string()))
        found = set(secret_scan.suspects(buf, offsets).tolist())
        assert found >= {i for i, t in enumerate(texts) if secret_scan.find_spans(t or "")} and found <= set(range(len(texts)))


def test_weak_parts_need_counterparts(spark):
    far = "x " * 400
    texts = ["user: anna", f"user: anna {far} password=hunter22", "user: anna password=hunter22", "see https://a.example/x", 'token="abcdef1" at https://a.example/x']
    got = secret_scan.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_linked for r in got} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1}


def test_keys_without_spaces_and_long_ones(spark):
    access, key, long = "AKIA" + "A1B2C3D4E5F6G7H8", "Ab1/" * 10, "Ab1+" * 21 + "Ab=="
    texts = [f"aws_access_key_id={access}\naws_secret_access_key={key}", f"aws_access_key_id = {access}\naws_secret_access_key = {key}", f"SECRET_KEY={key} {access}", f"https://a.example/x;AccountKey={long}", f"aws_secret_access_key={key}", f"password={key} {access}"]
    got = {r.doc_id: r for r in secret_scan.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, k in enumerate([key, key, key, long]):
        at = texts[i].index(k)
        assert f"key:{at}:{at + len(k)}" in got[i].spans.split(",")
    assert got[4].spans == "" and "key:" not in got[5].spans
    assert secret_scan.find_spans("Ab1" * 300_000 + "_") == []  # in linear time


def test_quality_classifier(spark, docs, labels):
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == docs.count()
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[20] and not kept[22] and kept[9] and kept[10]
    without = quality_classifier.quality_classifier(docs, labels.limit(0)).collect()
    assert all(r.kept and r.evidence == 0 for r in without)


def plain_posterior(rows, keep_at=0.3):
    """doc: (host rate, path rate, score, kept) from (doc, host, path, evidence), by loops over all rows."""
    unit = quality_classifier.UNIT
    us = [round(unit / (1 + math.exp(-e))) / unit for _, _, _, e in rows]
    mean = sum(us) / len(us)

    def prior(groups, centres):
        spread = noise = 0.0
        for g, own in groups.items():
            r, n = sum(own) / len(own), len(own)
            spread += n * (r - centres[g]) ** 2
            noise += sum((u - r) ** 2 for u in own) / (n - 1) if n > 1 else (r - centres[g]) ** 2
        variance = (spread - noise) / len(us)
        low, high = quality_classifier.PRIOR_RANGE
        return min(max(mean * (1 - mean) / variance - 1, low), high) if variance > 0 else high

    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, h, p, _), u in zip(rows, us):
        hosts[h].append(u)
        paths[h, p].append(u)
    a = prior(hosts, dict.fromkeys(hosts, mean))
    b = prior(paths, {(h, p): sum(hosts[h]) / len(hosts[h]) for h, p in paths})
    out = []
    for (doc, h, p, e), u in zip(rows, us):
        host = (sum(hosts[h]) - u + a * mean) / (len(hosts[h]) - 1 + a)
        path = (sum(paths[h, p]) - u + b * host) / (len(paths[h, p]) - 1 + b)
        edge = min(max(path, quality_classifier.EDGE), 1 - quality_classifier.EDGE)
        score = 1 / (1 + math.exp(-(e + math.log(edge / (1 - edge)) - math.log(mean / (1 - mean)))))
        out.append((doc, host, path, score, score >= keep_at))
    return out


def test_posteriors(spark, docs, labels):
    """The rates and scores of every row, worked out by loops, with null hosts, sparse sites and repeated rows."""
    got = quality_classifier.quality_classifier(docs, labels).collect()
    evidence = {(r.doc_id, r.evidence) for r in got}
    site = {r.doc_id: (r.source, r.lang) for r in docs.collect() if r.doc_id is not None}
    site_of_null = sorted(((r.source, r.lang) for r in docs.collect() if r.doc_id is None), key=str)
    assert len(site_of_null) == 2
    rows = [(r.doc_id, *site[r.doc_id], r.evidence) for r in got if r.doc_id is not None]
    base = next(e for i, e in evidence if i == 5)  # a null id has the text of 5, the other has no site
    rows += [(None, *(("s1", "en") if r.evidence == base else (None, None)), r.evidence) for r in got if r.doc_id is None]
    want = plain_posterior(rows)
    digits = [(r.doc_id, round(r.host_rate, 5), round(r.path_rate, 5), round(r.score, 5), r.kept) for r in got]
    assert sorted(digits, key=key) == sorted(((d, round(h, 5), round(p, 5), round(s, 5), k) for d, h, p, s, k in want), key=key)


def test_a_site_decides_on_a_borderline_document(spark):
    """Texts of middling evidence go at a site of junk and stay at a clean one; a new site has the global rate."""
    rng = random.Random(5)

    def text(bangs):
        w = prose(rng, 60).split()
        for i in rng.sample(range(len(w)), bangs):
            w[i] += "!!!"
        return " ".join(w) + "."

    rows = [(i, text(rng.randint(10, 24)), f"https://www.junk.example/a/{i}") for i in range(80)] + [(100 + i, text(rng.randint(0, 12)), f"http://clean.example/b/{i}") for i in range(80)]
    middling = text(11)
    rows += [(200, middling, "https://junk.example/a/x"), (201, middling, "http://clean.example/b/x"), (202, middling, "http://new.example/"), (203, middling, None)]
    marks = [(i, 0) for i in range(0, 80)] + [(100 + i, 1) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string")
    host, path = quality_classifier.site_columns("url")
    sites = {r.doc_id: (r.h, r.p) for r in docs.select("doc_id", host.alias("h"), path.alias("p")).collect()}
    assert (sites[0], sites[100], sites[202], sites[203]) == (("junk.example", "a"), ("clean.example", "b"), ("new.example", ""), (None, None))
    got = {r.doc_id: r for r in quality_classifier.quality_classifier(docs, spark.createDataFrame(marks, "doc_id long, quality int"), host=host, path=path).collect()}
    assert len({got[i].evidence for i in range(200, 204)}) == 1
    assert not got[200].kept and got[201].kept and got[200].path_rate < got[202].path_rate < got[201].path_rate
    want = {d: (round(s, 4), k) for d, _, _, s, k in plain_posterior([(i, *sites[i], got[i].evidence) for i in got])}
    assert {i: (round(r.score, 4), r.kept) for i, r in got.items()} == want


def test_classifier_on_held_out_labels(spark):
    """Four fifths of the labels fit it, the rest judge it."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, all_labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    got = quality_classifier.quality_classifier(docs, all_labels.where(~held)).join(all_labels.where(held), "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.93
