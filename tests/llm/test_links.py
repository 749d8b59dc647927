"""Decontamination (3), near-duplicates (7), chat (9), sharding (10) and the pipeline."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make_docs
from weekpanel.llm import chat, decontam, minmax, pipeline, sharding
from weekpanel.llm.base import components, numbered, words_of

WORD = "[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def shingle_counts(text_words):
    k = min(5, len(text_words))
    return Counter(tuple(text_words[i : i + k]) for i in range(len(text_words) - k + 1)) if k else Counter()


def weighted(a, b):
    low = sum((a & b).values())
    return low / (sum((a | b).values()) or 1)


def edit(text, places, word="changed"):
    w = text.split(" ")
    for p in places:
        w[p] = word
    return " ".join(w)


def test_decontamination_against_all_windows(spark, prose):
    items = [(k, prose(12 + 3 * k, 500 + k)) for k in range(8)] + [(20, "one two three"), (21, ""), (22, None)]
    rows = []
    for i in range(60):
        parts = [prose(40, 900 + i)]
        if i % 3 == 0:
            item = items[i % 8][1]
            parts.insert(1, [item, item.upper(), edit(item, [1]), edit(item, [len(item.split(" ")) // 2]), " ".join(item.split()[2:])][i // 3 % 5])
        if i % 20 == 7:
            parts.insert(0, "one  Two\nthree")
        rows.append((i, "\n".join(parts) if i % 2 else " ".join(parts)))
    rows += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    want = Counter()
    for i, text in rows:
        w = words(text)
        for k, item in items:
            own = words(item)
            if own and any(weighted(shingle_counts(w[a : a + len(own)]), shingle_counts(own)) >= 0.8 for a in range(max(1, len(w) - len(own) + 1))):
                want[i, k] += 1
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(spark, rows)
    found = decontam.find(docs, benchmark).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == want and len(want) >= 12
    assert all(r.distance <= decontam.RADIUS and r.similarity >= 0.8 for r in found)
    small = decontam.find(docs, benchmark, item_bytes=300).collect()  # several passes
    assert sorted(map(tuple, small)) == sorted(map(tuple, found))
    clean = decontam.filter_leaks(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.find(docs.limit(0), benchmark).count() == 0 and decontam.find(docs, benchmark.limit(0)).count() == 0


def edited_items(rng, vocabulary, count, least, most, kind):
    """(item words, text words, window start): edits that leave a similarity of 0.80 to 0.88, at one end, in one stretch,
    spread in two places, or a cut end."""
    out = []
    while len(out) < count:
        n = int(rng.integers(least, most))
        said = rng.choice(vocabulary, n)
        new, k = said.copy(), max(1, (n - 4) // 9)
        if kind == "end":
            new[n - k :] = rng.choice(vocabulary, k)
        elif kind == "stretch":
            k = max(1, k - 4)
            at = int(rng.integers(0, n - k))
            new[at : at + k] = rng.choice(vocabulary, k)
        else:
            for at in rng.choice(n, max(1, (n - 4) // 45), replace=False):
                new[at] = rng.choice(vocabulary)
        out.append((said, np.concatenate([rng.choice(vocabulary, 20), new, rng.choice(vocabulary, 20)])))
    return out


@pytest.mark.parametrize("kind", ["end", "stretch", "spread"])
@pytest.mark.parametrize("distinct", [60, 3000])
def test_recall_at_the_similarity_against_all_windows(kind, distinct):
    """Of the items of which some window of the text reaches the similarity, 99 of 100 are found through the index."""
    rng = np.random.default_rng(7)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(distinct)])
    cases = edited_items(rng, vocabulary, 250, 50, 180, kind)
    index = decontam.Index([(k, " ".join(said)) for k, (said, _) in enumerate(cases)])
    near, found = 0, 0
    for k, (said, text) in enumerate(cases):
        (_, h, _), = words_of([" ".join(text)], True)
        own = len(said)
        if any(decontam.similarity(decontam.weighted(h[a : a + own]), index.sets[k]) >= 0.8 for a in range(len(h) - own + 1)):
            near += 1
            found += any(m[0] == k for m in index.matches(h))
    assert near >= 60 and found >= 0.99 * near


def test_hamming_blocks_find_every_fingerprint_in_the_radius_and_few_others():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (400, decontam.BLOCKS), dtype=np.uint32)
    for k in range(400):
        value = a[k].copy()
        for bit in rng.choice(decontam.BITS, rng.integers(0, decontam.RADIUS + 1), replace=False):
            value[bit // 32] ^= np.uint32(1) << np.uint32(bit % 32)
        rows, distance = decontam.lookup(a, value)
        assert k in rows and (distance <= decontam.RADIUS).all()
    others = rng.integers(0, 2**32, (200_000, decontam.BLOCKS), dtype=np.uint32)
    passed = (np.bitwise_count(others ^ a[0]) <= decontam.BLOCK_RADIUS).any(axis=1).mean()
    assert 0 < passed < 0.1 and len(decontam.lookup(others, a[0])[0]) <= 10


def test_fingerprints_of_windows_are_those_of_their_words():
    (_, h, _), = words_of(["the quick brown fox jumps over the lazy dog " * 3], True)
    sums = decontam.signs(h)
    for a, b in ((0, 9), (4, 20), (26, 27)):
        assert (decontam.fingerprint(sums[[b]] - sums[[a]]) == decontam.fingerprint(decontam.signs(h[a:b])[-1:])).all()


def components_of(rows, percent=85):
    sets = {i: set(shingle_counts(words(t))) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(ids[x]), root(ids[y])))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [minmax.BLOCK, 400])
def test_near_duplicates_against_all_pairs(spark, prose, odd_texts, monkeypatch, block):
    monkeypatch.setattr(minmax, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(1000 + k, t) for k, t in enumerate(odd_texts)]
    for group in range(12):
        base = prose(60 + 15 * group, 40 + group).replace("\n", " ")
        text = base
        for k in range(8):
            n = len(text.split(" "))
            # copies of the base, and a chain of edits whose ends are far apart
            text = edit(text if group % 2 else base, rng.choice(n, rng.integers(0, 3), replace=False), f"w{k}")
            rows.append((group * 10 + k, text.upper() if k == 5 else text))
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    want = components_of(rows)
    got = minmax.near_duplicates(make_docs(spark, rows).withColumn("root", F.lit(1))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_at_the_bound(spark, prose, percent):
    rows = []
    # one changed word takes five of n - 4 shingles: similarity 0.80 to 0.85 from 49 to 65 words
    for k, n in enumerate(range(44, 72)):
        text = prose(n, 3000 + n).replace("\n", " ")
        rows += [(10 * k, text), (10 * k + 1, edit(text, [n // 2]))]
    want = components_of(rows, percent)
    got = minmax.near_duplicates(make_docs(spark, rows), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert {i: r for i, (_, r) in want.items()} != {i: r for i, (_, r) in components_of(rows, 165 - percent).items()}


def test_near_dedup_stage_takes_eighty(spark, prose):
    text = prose(56, 3100).replace("\n", " ")
    rows = [(1, text), (2, edit(text, [30])), (3, prose(56, 3101))]
    assert components_of(rows, 80)[2][1] == 1 and components_of(rows, 85)[2][1] == 2
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, make_docs(spark, rows), "").collect()} == {1, 3}


def test_bands_find_pairs_at_the_bound():
    rng = np.random.default_rng(80)
    for percent in (80, 85):
        pairs = []
        for _ in range(3000):
            a = rng.integers(0, 2**63, 180, dtype=np.uint64)
            union = 180 * 100 // percent
            b = np.concatenate([a, rng.integers(0, 2**63, union - 180, dtype=np.uint64)])
            pairs += [a, b]
        sizes = np.array([len(p) for p in pairs])
        keys = minmax.bands(np.concatenate(pairs), np.cumsum(sizes) - sizes, minmax.band_rows(percent))
        assert (keys[::2] == keys[1::2]).any(axis=1).all()
    with pytest.raises(ValueError):
        minmax.band_rows(5)


def test_ties_of_a_large_group_are_few(spark):
    rng = np.random.default_rng(6)
    heads = sorted({(int(a), i) for i in range(40, 1000) for a in rng.integers(i % 2 * 20, i % 2 * 20 + 20, 30)})
    ties = minmax._ties(spark.createDataFrame(heads, "a long, node long"))
    assert ties.count() < len(heads) / 5
    got = {r.node: r.root for r in components(ties).collect()}
    assert got == {r.node: r.root for r in components(spark.createDataFrame(heads, "a long, b long")).collect()}


def test_near_duplicates_of_odd_input(spark):
    rows = [(None, "some text without an id here"), (5, "some text without an id here"), (7, "a b c"), (7, "a b c"), (3, "A  b\tc"), (9, None), (8, " ")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(make_docs(spark, rows)).collect()), key=str)
    assert (3, 1, 3, True) in got and got.count((7, 1, 3, False)) == 2 and (9, 0, 9, True) in got and (8, 0, 8, True) in got and len(got) == 7
    assert minmax.near_duplicates(make_docs(spark, [])).count() == 0
    left = minmax.filter_near_duplicates(make_docs(spark, rows)).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 3, 5, 8, 9]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, int(x)) for x in range(501, 560)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1080, (70, 2))]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


TALK = "conv_id long, turn long, role string, text string"


def plain_chat(rows):
    turns = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
    loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss)


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "&lt;| &amp; &", "a<", "|x", "", None, "é日\n\n<|im_start|>user\n", "&#10;<<||>>", "\\1 $0"]
    rows = [(k, j, ("user", "assistant")[j % 2], nasty[(k + j) % len(nasty)]) for k in range(9) for j in range(4)]
    rows += [(20, 1, "assistant", "first"), (21, 0, "system", "s"), (21, 1, "assistant", "too soon"), (22, 0, "user", "x"), (22, 0, "user", "x"),
             (23, 0, "ro<|le\nx", "odd role"), (23, 1, None, "no role"), (24, None, "user", "no turn"), (None, 0, "user", "no id"), (25, 0, "user", "y" * 100_000), (25, 1, "assistant", "z" * 100_000)]
    out = chat.format_chat(spark.createDataFrame([(*r, 1) for r in rows], TALK + ", turns int"))
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == {k: plain_chat(g) for k, g in groups.items()}
    assert [k for k in sorted(got, key=str) if got[k].valid] == [0, 1, 2, 25, *range(3, 9)]
    full = {r.conv_id: r for r in out.collect()}
    assert all("".join(s.text for s in r.segments) == r.formatted for r in full.values())
    assert full[21].first_bad == 1 and full[20].first_bad == 0
    assert chat.format_chat(spark.createDataFrame([], TALK)).count() == 0


def shards_hold(got, rows, n_shards=16):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes[s] for s in range(n_shards)) - min(sizes[s] for s in range(n_shards)) <= 1 and all(0 <= r.shard < n_shards for r in got)
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_shards_keep_copies_together(spark):
    rows = [(i, f"single {i}") for i in range(300)] + [(1000 + i, f"copy {i % 30}") for i in range(240)] + [(2000 + i, "hot") for i in range(260)]
    got = sharding.assign_shards(make_docs(spark, rows), salt_rows=50).collect()
    shards_hold(got, rows)
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    assert np.mean([len(places[zlib.crc32(f"copy {k}".encode())]) == 1 for k in range(30)]) > 0.9
    # a third of all rows cannot fit one shard, but fills few
    hot = Counter(r.shard for r in got if r.doc_id >= 2000)
    assert sum(n for _, n in hot.most_common(8)) > 0.8 * 260


@pytest.mark.parametrize("hot", [1, sharding.HOT])
def test_shards_of_many_copies_in_many_parts(spark, hot):
    """Salts without a ceiling: more parts than rows of the usual group, told by broadcast or by shuffle."""
    rows = [(i, "hot" if i % 3 == 0 else f"copy {i % 40}" if i % 3 == 1 else f"single {i}") for i in range(900)]
    got = sharding.assign_shards(make_docs(spark, rows), salt_rows=2, most_hot=hot).collect()
    shards_hold(got, rows)


def plain_propagation(rows, n_shards, rounds):
    """Label propagation row by row with the same quotas and starts by a plain order: groups of copies seek one shard."""
    total = len(rows)
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    shard = {i: i % n_shards for t, g in groups.items() if len(g) > 1 for i in g}
    for _ in range(rounds):
        loads = Counter(shard.values())
        for t, g in groups.items():
            if len(g) < 2:
                continue
            goal = Counter(shard[i] for i in g).most_common(1)[0][0]
            for i in g:
                if shard[i] != goal and loads[goal] < quota[goal]:
                    loads[shard[i]] -= 1
                    loads[goal] += 1
                    shard[i] = goal
    return sum(len({shard[i] for i in g}) - 1 for t, g in groups.items() if len(g) > 1)


def cuts(got):
    """Shards beyond the first that the copies of a text are spread over, summed over texts."""
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32, r.size].add(r.shard)
    return sum(len(p) - 1 for p in places.values())


def test_shards_cut_as_few_links_as_a_plain_propagation(spark):
    rows = [(i, f"copy {i % 60}") for i in range(420)] + [(1000 + i, f"single {i}") for i in range(600)] + [(3000 + i, "many") for i in range(90)]
    got = sharding.assign_shards(make_docs(spark, rows)).collect()
    shards_hold(got, rows)
    texts = dict(rows)
    rng = np.random.default_rng(1)
    deal = rng.permutation(np.arange(len(rows)) % 16)
    places = defaultdict(set)
    for (i, t), s in zip(rows, deal):
        places[t].add(int(s))
    random_cut = sum(len(p) - 1 for p in places.values())
    assert len(texts) == len(rows) and cuts(got) <= 0.1 * random_cut and cuts(got) <= plain_propagation(rows, 16, 16) + 10


def test_shards_of_odd_input(spark, odd_texts):
    rows = [(k, t) for k, t in enumerate(odd_texts)] + [(6, odd_texts[6]), (6, odd_texts[6])]
    shards_hold(sharding.assign_shards(make_docs(spark, rows).withColumn("shard", F.lit(9))).collect(), rows)
    assert sharding.assign_shards(make_docs(spark, [])).count() == 0
    every = [(i, "same") for i in range(50)]
    shards_hold(sharding.assign_shards(make_docs(spark, every), salt_rows=10).collect(), every)


def test_numbers_are_gapless(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    got = numbered(df, "g", F.pmod(F.col("id"), F.lit(7)), ["id"], "n").collect()
    for g in range(3):
        own = sorted((r.n, r.id) for r in got if r.g == g)
        assert [n for n, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted((i for _, i in own), key=lambda i: (i % 7, i))


def test_pipeline_against_a_plain_version(spark, prose, odd_texts, tmp_path):
    items = [(1, prose(40, 77).replace("\n", " "))]
    rows = [(i, prose(60, 100 + i)) for i in range(40)]
    rows += [(50, " ".join(w.upper() + "!!" for w in prose(80, 3).split())), (51, rows[0][1]), (52, edit(rows[2][1].replace("\n", " "), [3])),
             (53, rows[2][1].replace("\n", " ")), (54, prose(30, 8) + "\n" + items[0][1]), (55, rows[4][1] + "\n" + prose(60, 9)), (56, None), (57, "")]
    make_docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, clean = sizes
    assert set(quality) == {i for i, _ in rows} - {50}
    assert set(lines) == set(quality) - {51} and lines[55] == prose(60, 9)
    # 52 and 53 are one line each, and near copies of each other and of document 2
    assert set(near) == set(lines) - {52, 53}
    assert set(clean) == set(near) - {54}
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean) and all(r.round_trip for r in got.values())
    assert {i: r.n_chars for i, r in got.items()} == {i: len(t or "") for i, t in clean.items()}
