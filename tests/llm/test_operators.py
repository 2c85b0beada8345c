"""Each operator against a brute-force version on a small table, and on the odd and the empty table."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, fingerprints, language_id, line_dedup, nbest, near_dedup, packing, quality, sharding, substring_dedup, token_files, tokens


def ids_of(text, end):
    t = tokens.Encoder(tokens.vocabulary()).tokenizer
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# quality rules ---------------------------------------------------------------------------------------------------------


def test_quality_counts(odd):
    found = {r.doc_id: r for r in quality.quality_rules(odd, "doc_id").collect()}
    assert (found[1].n_words, found[1].n_repeat_words, found[1].base_failed) == (12, 0, False)
    assert found[2].n_words == found[3].n_words == found[6].n_words == 0 and found[2].base_failed
    assert found[8].n_symbols == 7 and found[4].n_words == 30_000 and found[4].n_repeat_words == 30_000


def test_quality_repeats_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_rules(df, "doc_id").collect():
        w = texts[r.doc_id].split()
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert r.n_repeat_words == len(hit)


def test_quality_filter_keeps_columns(odd, nothing):
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 7, None}
    assert quality.filter_documents(nothing).count() == 0


# packing ---------------------------------------------------------------------------------------------------------------


def test_packing_pieces(odd, nothing):
    limits = packing.Limits(256, 4, 200)
    rows = packing.pack_documents(odd, limits=limits).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= 256 and len(pieces) <= 4 and sum(r.loss_tokens for r in pieces) <= 200
    texts = {r.doc_id: r.text for r in odd.collect()}
    for doc_id in (1, 2, 3, 4, 8):
        ids, at = ids_of(texts[doc_id], 0), 0
        for r in sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length]) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    assert packing.pack_documents(nothing).count() == 0


def item(tokens, prompt, key):
    return packing.item(key, tokens, 0, bytes(4 * tokens), ((prompt, tokens),))


def plain_pack(items, limits):
    """The heuristic, whole items, a step at a time over all that are left."""
    left, out = list(items), []
    while left:
        room, sequence = [limits.tokens, limits.segments, limits.loss_tokens], []
        while True:
            found = [(sum(d * r / m**2 for d, r, m in zip(v, room, (limits.tokens, limits.segments, limits.loss_tokens), strict=True)), v, x) for x in left for v in [(x.tokens, 1, x.loss)] if all(d <= r for d, r in zip(v, room, strict=True))]
            if not found:
                break
            _, v, x = max(found, key=lambda f: (round(f[0], 12), f[1]))
            sequence.append(v)
            left.remove(x)
            room = [r - d for r, d in zip(room, v, strict=True)]
        out.append(sequence)
    return out


@pytest.mark.parametrize("limits", [packing.Limits(100, 50, 100), packing.Limits(1000, 3, 1000), packing.Limits(1000, 50, 60)])
def test_each_limit_decides(limits):
    rng = random.Random(6)
    items = [item(n, rng.randint(0, n - 1), k) for k, n in enumerate(rng.randint(1, 60) for _ in range(60))]
    found = [[(x.tokens, 1, x.loss) for x in s] for s in packing.pack(items, limits, whole=True)]
    assert found == plain_pack(items, limits)
    full = [max(sum(v[k] for v in s) / m for s in found) for k, m in enumerate((limits.tokens, limits.segments, limits.loss_tokens))]
    assert max(full) == full[[limits.tokens == 100, limits.segments == 3, limits.loss_tokens == 60].index(True)] > 0.95 and sorted(full)[1] < 0.95


def test_pieces_fill_sequences():
    rng = random.Random(1)
    items = [item(n, n // 8, k) for k, n in enumerate(rng.randint(1, 700) for _ in range(500))]
    limits = packing.Limits(1024, 64, 960)
    out = packing.pack(items, limits)
    total = sum(x.tokens for x in items)
    assert sum(x.tokens for s in out for x in s) == total and len(out) <= total / 1024 + 2
    assert all(sum(x.loss for x in s) <= 960 for s in out)


def test_conversations(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} " * (1 + c % 5)) for c in range(30) for t in range(4)] + [(40, 0, "user", None), (None, 0, "user", "lost")]
    rows = packing.pack_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3), limits=packing.Limits(256, 8, 100)).collect()
    for c in range(30):
        own = [(ids_of(x, 0), role) for k, _, role, x in turns if k == c]
        pieces = sorted((r for r in rows if r.doc_id == c), key=lambda r: r.start)
        ids, at = [i for x, _ in own for i in x], 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids) and sum(r.loss_tokens for r in pieces) == sum(len(x) for x, role in own if role == "assistant")
    assert {r.doc_id for r in rows} == {*range(30), 40}
    by = Counter()
    for r in rows:
        by[r.sequence_id] += r.loss_tokens
    assert max(by.values()) <= 100


# fingerprints ----------------------------------------------------------------------------------------------------------


def test_fingerprints_in_order(odd, nothing):
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == 10 and fingerprints.fingerprints(nothing).count() == 0
    order = sorted([(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd.collect()])
    expect = Counter()
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        expect[i, len(text), hashlib.sha256(fingerprints.edited(text, following).encode()).hexdigest()] += 1
    assert Counter((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in rows) == expect
    same = {r.fingerprint for r in rows if r.doc_id in (1, 7)}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_fingerprint_diff_finds_the_paragraph():
    a, b, c = (fingerprints.written(fingerprints.tree(f"one two three\nfour five six\n\n{x}\n# nine\nten")) for x in ("seven eight", "seven eighty", "seven eight"))
    assert fingerprints.diff(a, a) == [] and fingerprints.diff(a, b) == [(1, 0)] and a == c != b


def random_text(rng):
    return "".join(rng.choice(["word ", "seven ", "a ", "\n", "\n\n", " ", "# ", "é", "three four "]) for _ in range(rng.randint(0, 60)))


def test_a_path_proves_every_leaf():
    rng = random.Random(2)
    for _ in range(50):
        text = random_text(rng)
        own, parts = fingerprints.tree(text), fingerprints.sections_of(text)
        assert "\n".join(line for s in parts for line in s) == text
        for s, lines in enumerate(parts):
            for p, line in enumerate(lines):
                for k, leaf in enumerate(fingerprints.leaves(line) if line else []):
                    path = fingerprints.proof(own, s, p, k)
                    assert fingerprints.proven(leaf.encode(), path, own.root) and not fingerprints.proven(leaf.encode() + b"x", path, own.root)


def test_roots_tell_texts_apart():
    rng, by = random.Random(7), {}
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "seven"]) for _ in range(rng.randint(0, 6)))
        assert by.setdefault(fingerprints.tree(text).root, text) == text


def plain_likeness(a, b):
    """Over lists of digests: sections in common, then paragraphs of the others, then leaves."""
    if a.root == b.root:
        return 1.0
    size = lambda t: sum(len(x) for _, ps in t.sections for _, x in ps)
    if not size(a) + size(b):
        return 0.0
    x, y, found = [s for _, s in a.sections], [s for _, s in b.sections], 0
    for below in (lambda s: sum(len(v) for _, v in s), lambda p: len(p[1]), lambda leaf: 1):
        for v in list(x):
            if v in y:
                x.remove(v)
                y.remove(v)
                found += below(v)
        x, y = ([c for v in side for c in (v[1] if isinstance(v, tuple) else v if isinstance(v, list) else [])] for side in (x, y))
    return 2 * found / (size(a) + size(b))


def test_likeness_against_plain_descent():
    rng = random.Random(9)
    for _ in range(300):
        text = random_text(rng)
        lines = text.split("\n")
        other = "\n".join(x if rng.random() < 0.7 else x + random_text(rng) for x in lines) if rng.random() < 0.8 else random_text(rng)
        a, b = fingerprints.tree(text), fingerprints.tree(other)
        found = fingerprints.likeness(*(fingerprints.levels(fingerprints.written(t)) for t in (a, b)))
        assert found == pytest.approx(plain_likeness(a, b))


@pytest.mark.parametrize("rows", [1, 7, 300])
def test_ranges_follow_each_other(spark, rows):
    ids = random.Random(rows).sample(range(-(1 << 60), 1 << 60), rows - 1) + [-(1 << 63)]
    df = spark.createDataFrame([(i, f"text of {i} and more words") for i in ids], "doc_id long, text string").repartition(3)
    order = sorted(ids)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    out = fingerprints.fingerprints(df, 1 << 9).collect()
    expect = {i: hashlib.sha256(fingerprints.edited(f"text of {i} and more words", f"text of {after[i]} and more words").encode()).hexdigest() for i in ids}
    assert len(out) == rows and {r.doc_id: r.edited_sha256 for r in out} == expect


# language --------------------------------------------------------------------------------------------------------------


def test_gradients_match_differences():
    model = language_id.Model.new(["a", "b"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    data, target = np.array([[97, 98, 99], [120, 98, 32]], np.uint8), np.array([0, 1])
    before = {k: v.copy() for k, v in model.p.items()}

    def loss():
        logs = model.log_probabilities(data)
        return -float(np.mean(logs[:, np.arange(2), target]))

    state = {}
    model.train(data, target, np.ones(2), 0.0, state)
    for name, at in (("gf", (1, 2)), ("cb", (0, 1)), ("xf", (98, 4)), ("ob", (2, 1))):
        model.p = {k: v.copy() for k, v in before.items()}
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        assert state[f"m{name}"][at] / 0.1 == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_languages(spark, odd, nothing):
    words = {"x": "aba bab aab", "y": "cdc dcd ccd"}
    rows = [(k, " ".join(random.Random(k).choices(words[lang].split(), k=30)), lang) for k in range(300) for lang in ["xy"[k % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language_id.language_id(df).collect()
    truth = {k: lang for k, _, lang in rows}
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    found = {r.doc_id: r for r in language_id.language_id(odd).collect()}
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (2, 3, 6)) and found[4].lang_pred in ("en", "de", "fr")
    assert language_id.language_id(nothing).count() == 0


# near dedup ------------------------------------------------------------------------------------------------------------


def brute_simhash(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    size = min(size, len(w))
    n = len(w) - size + 1
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(values, bits):
    u = sorted(set(values))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(u):
        for y in u[:i]:
            if (x ^ y).bit_count() <= bits:
                root[find(x)] = find(y)
    return {x: find(x) for x in u}


def test_near_classes(spark, odd, nothing, tiny):
    docs = common.read_table(spark, tiny, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = {k: brute_simhash(t, 4) for k, t in texts.items()}
    comp = brute_components(fp.values(), 4)
    least = {}
    for k, f in sorted(fp.items()):
        least.setdefault(comp[f], k)
    out = near_dedup.near_classes(docs).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in out} == {k: (f, least[comp[f]]) for k, f in fp.items()}
    found = near_dedup.near_classes(odd).collect()
    assert len(found) == 10 and {r.component_id for r in found if r.doc_id in (1, 7)} == {1} and {r.component_id for r in found if r.doc_id in (2, 3, 6)} == {2}
    assert near_dedup.near_classes(nothing).count() == 0 and near_dedup.near_dedup(odd).columns == odd.columns


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    a, b = "one two three four five six seven", " ".join(f"other{k}" for k in range(40))
    rows = [(1, a), (7, a), (7, b), (9, b), (9, b), (None, a)]
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in out) == Counter([(1, a), (7, b), (None, a)])


@pytest.mark.parametrize("hot", [8192, 100])
def test_links_of_a_dense_group(spark, hot):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    xs = {int(b) ^ sum({1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 9))}) for b in base for _ in range(400)} | {int(z) for z in rng.integers(0, 1 << 63, 500, dtype=np.uint64)}
    comp = brute_components(xs, 4)
    expect = {}
    for x, c in comp.items():
        expect.setdefault(c, set()).add(x)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in xs], "fp long")
    from quarry.llm.components import components

    found = {}
    for r in components(near_dedup.fingerprint_links(df, 4, hot)).collect():
        found.setdefault(r.label, set()).add(int(np.int64(r.node).view(np.uint64)))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in expect.values() if len(v) > 1)


# n best ----------------------------------------------------------------------------------------------------------------


def test_n_best_against_all_segmentations():
    rng = random.Random(1)
    own = nbest.Lattice(tokens.vocabulary("piece_bpe_32k.model"), 4, scores=np.array([-rng.uniform(3, 20) for _ in range(32_000)]).round(6))

    def brute(text):
        s, out = nbest.MARK + text.replace(" ", nbest.MARK), []

        def go(i, codes, score):
            if i == len(s):
                out.append((score, own.ids(codes)))
                return
            alone = False
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in own.pieces:
                    alone |= j == i + 1
                    k, x = own.pieces[s[i:j]]
                    go(j, [*codes, k], score + x)
            if not alone:
                go(i + 1, [*codes, nbest.OTHER + ord(s[i])], score + own.unknown)

        go(0, [], 0.0)
        return sorted(out, key=lambda x: (-x[0], len(x[1]))) if text else [(0.0, [])]

    for _ in range(150):
        text = "".join(rng.choice("theaion .,\n\0 é一\U0001f600") for _ in range(rng.randint(0, 9)))
        best = own.encode(text)
        score = {tuple(i): x for x, i in brute(text)}
        found = [tuple(np.frombuffer(i, "<u4").tolist()) for _, i in best]
        # Ids by ids, but where segmentations have one score (the same pieces in another order).
        assert len(set(found)) == len(found) == min(4, len(score))
        assert [score[i] for i in found] == pytest.approx(sorted(score.values(), reverse=True)[:4], abs=1e-9)
        assert [s for s, _ in best] == pytest.approx([score[i] for i in found], abs=2e-3)
        assert list(own.encode_all(pa.array([text])))[0] == best
        assert all(own.decode(np.frombuffer(i, "<u4"))[1:] == text.encode() for _, i in best)


def test_long_segments_join_their_parts():
    own = nbest.Lattice(tokens.vocabulary("piece_bpe_32k.model"))
    text = "一二三" * 60 + "the" * 30
    best = own.encode(text)
    assert len(best) == 3 and all(own.decode(np.frombuffer(i, "<u4"))[1:] == text.encode() for _, i in best) and best[0][0] >= best[1][0] >= best[2][0]


def test_expectation_maximisation_finds_the_pieces_in_use():
    own = nbest.Lattice(tokens.vocabulary("piece_bpe_32k.model"))
    words = {nbest.MARK + w: c for w, c in (("the", 50), ("then", 9), ("there", 7), ("on", 20), ("ion", 5))}

    def likelihood(scores):
        p, total = np.exp(scores), 0.0
        for w, c in words.items():
            ahead = [1.0] + [0.0] * len(w)
            for i, j, k in sorted(own.spans(w)):
                ahead[j] += ahead[i] * p[k]
            total += c * np.log(ahead[-1])
        return total

    fits = [likelihood(own.fit(words, k)) for k in range(6)]
    assert all(b >= a - 0.05 for a, b in zip(fits, fits[1:], strict=False)) and fits[-1] > fits[0] + 10
    found = own.fit(words, 5)
    assert int(np.argmax(found)) == own.pieces[nbest.MARK + "the"][0] and np.exp(found[[k for k, _ in own.pieces.values()]]).sum() == pytest.approx(1)


def test_n_best_odd(odd, nothing):
    rows = nbest.encode_documents(odd).collect()
    assert len(rows) == 10 and all(r.round_trip and len(r.scores) == len(r.ids_crc32) for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (2, 3)} == {0} and nbest.encode_documents(nothing).count() == 0


# substring dedup -------------------------------------------------------------------------------------------------------


def brute_substrings(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return Counter(out)


def test_substrings_against_brute_force(spark):
    rng = random.Random(3)
    rnd = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    passages = [rnd(rng.randint(30, 200)) for _ in range(12)]
    rows = [(i, "".join(rng.choice([rnd(rng.randint(0, 60)), rng.choice(passages), rng.choice(passages)[10:70]]) for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(300, None), (301, ""), (302, "a" * 400), (303, "b" + "a" * 300), (304, "ab" * 200), (305, "a" * 49), (5, rows[7][1]), (7, rows[5][1]), (7, rows[7][1]), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df).collect()) == brute_substrings(rows)


def test_buckets_are_refined():
    rng = random.Random(8)
    for _ in range(100):
        rows = [tuple(rng.randint(0, 2) for _ in range(4)) for _ in range(rng.randint(1, 40))]
        columns = [np.array(c) for c in zip(*rows, strict=True)]
        number = np.unique(columns[0], return_inverse=True)[1]
        for c in columns[1:]:
            number = substring_dedup.refine(number, c)
        assert len(set(rows)) == len(set(number.tolist())) == len(set(zip(rows, number.tolist(), strict=True)))


def test_long_runs_differ_in_the_middle(spark):
    rng = random.Random(12)
    whole = "ab" * 4000
    rows = [(k, whole[:i] + "X" + whole[i + 1 :]) for k, i in enumerate(rng.sample(range(8000), 6))] + [(9, whole), (10, whole), (11, "a" * 5000), (12, "a" * 5001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df).collect()) == brute_substrings(rows)


def test_substrings_odd(odd, nothing):
    kept = substring_dedup.without_repeats(odd)
    by = {r.doc_id: r for r in kept.collect() if r.doc_id not in (None, 7)}
    assert kept.columns == odd.columns and by[5].text == "" and by[2].text is None and by[4].text.startswith("word0x0")
    assert kept.count() == 10 and substring_dedup.substring_dedup(nothing).count() == 0


# sharding --------------------------------------------------------------------------------------------------------------


def test_rooms_find_the_tightest():
    rng, rooms, plain = random.Random(2), sharding.Rooms(), []
    for k in range(500):
        if rng.random() < 0.6:
            room = rng.randint(0, 50)
            rooms.add(room, k)
            plain.append((room, k))
        else:
            size = rng.randint(0, 50)
            best = min((x for x in plain if x[0] >= size), default=None)
            assert rooms.take(size) == best
            if best:
                plain.remove(best)


def plain_best_fit(sizes, capacity, bins):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if not fits:
            rooms.append(max(capacity, size) - size)
            continue
        rooms[min(fits, key=lambda k: (rooms[k], k))] -= size
    return sorted(rooms) if len(rooms) <= bins else None


def test_best_fit_of_classes_is_that_of_groups():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, rng.choice([9, 60, 300])) for _ in range(rng.randint(1, 80))]
        classes, bins = sorted(Counter(sizes).items(), reverse=True), rng.randint(1, 12)
        least = sharding.fair_share(classes, bins)
        for capacity in (least, least + least // 3, 2 * least + 300):
            plain, found = plain_best_fit(sizes, capacity, bins), sharding.best_fit_decreasing(classes, capacity, bins)
            assert (plain is None) == (found is None)
            if found:
                used = Counter()
                for (size, count), put in zip(classes, found, strict=True):
                    assert sum(m for m, _ in put) == count
                    for m, b in put:
                        used[b] += m * size
                own = sorted(max(capacity, max([s for (s, _), put in zip(classes, found, strict=True) if any(x == b for _, x in put)])) - u for b, u in used.items())
                assert own == plain


def test_a_group_over_a_fair_share_has_its_own_shard(spark):
    rows = [(k, "y" * 100) for k in range(500)] + [(1000 + k, "z" * (1 + k)) for k in range(300)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes, hot = Counter(), {r.shard for r in out if r.doc_id < 500}
    for r in out:
        sizes[r.shard] += r.size
    others = [n for s, n in sizes.items() if s not in hot]
    assert len(hot) == 1 and len(others) == 7 and max(others) <= 1.02 * min(others)
    assert all((r.shard in hot) == (r.doc_id < 500) for r in out)


def test_shards_near_equal(spark, odd, nothing):
    rng = random.Random(5)
    rows = [(k, "x" * rng.randint(1, 400)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(df, 8).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
        assert r.size == len(rows[r.doc_id][1]) + 16 and r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode())
    assert max(sizes.values()) <= 1.02 * min(sizes.values())
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    groups = {}
    for r in out:
        groups.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert all(len(v) == 1 for v in groups.values())
    assert sharding.shard_documents(odd).count() == 10 and sharding.shard_documents(nothing).count() == 0


# tokens ----------------------------------------------------------------------------------------------------------------


def test_tokens_of_odd_white_space():
    own = tokens.Encoder(tokens.vocabulary())
    texts = ["x  y", "  x", "x\n y", "x \n y", "x \n \n  y", "a", " ", "", "  ", "don't  it's 5%%% foo\n", "<|endoftext|> x", "é.\nè,  ", "a\x0b b\x1c c　 d   e", "x ", " \n", "12 3.4, ab1, x-y."]
    ids, at = own.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files_in_order(odd, nothing):
    rows = token_files.read_documents(token_files.write_tokens(odd, size=50)).collect()
    order = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in odd.collect()))
    start, expect = 0, Counter()
    for i, t in order:
        ids = ids_of(t, 2)
        expect[i, start, len(ids), crc(ids)] += 1
        start += len(ids)
    assert Counter((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in rows) == expect
    assert token_files.read_documents(token_files.write_tokens(nothing)).count() == 0


# line dedup ------------------------------------------------------------------------------------------------------------


def test_lines(spark, odd, nothing, monkeypatch):
    rows = [(k, f"Accept all\nunique {k}\n\n  Accept all  " if k % 2 else f"only {k}", "h1") for k in range(20)] + [(99, None, None), (98, "Accept all", "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (line_dedup.BROADCAST_KEYS, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
        out = {r.doc_id: r for r in line_dedup.line_dedup(df).collect()}
        assert out[1].text == "unique 1\n" and out[1]._n_dropped == 2 and out[2].text == "only 2" and out[99].text is None and out[98].text == "Accept all"
    assert line_dedup.line_dedup(odd).count() == 10 and line_dedup.line_dedup(nothing).count() == 0
    urls = spark.createDataFrame([("http://U@Www.Example.com:80/x",), ("no url",)], "u string").select(line_dedup.host_of(F.col("u")).alias("h")).collect()
    assert [r.h for r in urls] == ["www.example.com", None]


def test_substring_dedup_of_many_short_rows(spark):
    passage = " ".join(f"shared{k}" for k in range(20))
    rows = [(k, passage if k in (5, 66_000) else "short") for k in range(70_000)]
    df = spark.createDataFrame(pa.table({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": [t for _, t in rows]})).coalesce(1)
    out = substring_dedup.substring_dedup(df)
    assert [(r.doc_id, r.n_removed) for r in out.where("n_removed > 0").collect()] == [(66_000, len(passage))]


def test_hot_passages_are_settled_in_map_tasks(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    hot, other = word(160), word(90)
    rows = [(rnd.randrange(70), word(rnd.randrange(40)) + hot[rnd.choice((0, 0, 0, 20)) :] + rnd.choice(("", other)) + word(rnd.randrange(40))) for _ in range(120)]
    rows += [rows[3], rows[4], (999, hot * 3), (-5, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df).collect()) == brute_substrings(rows)


def test_runs_combined_in_a_batch():
    same = [7, 1, 2, 0]
    rows = [[*same, 5, 50, 1 << 22 | 3], [*same, 4, 40, 9 << 22 | 3], [*same, 4, 41, 3], [*same, 6, 60, 4], [8, 1, 2, 0, 9, 90, 3]]
    out = substring_dedup.combined([np.array(c, np.int64) for c in zip(*rows, strict=True)])
    assert out.column("known").to_pylist() == [True, False, False, False, False]
    assert out.column("bucket").to_pylist()[1:] == [7, 7, 7, 8] and substring_dedup.combined([np.zeros(0, np.int64)] * 7).num_rows == 0


def test_settled_runs_leave_in_groups_of_documents():
    rng = np.random.default_rng(3)
    n = 450_000  # several tables of key_groups()
    bucket, doc = np.sort(rng.integers(0, 60_000, n)), rng.integers(0, 500, n)
    zero, span = np.zeros(n, np.int64), rng.integers(0, 1 << 40, n) << 22 | 1
    columns = [bucket, zero, zero, zero, doc, doc * 7, span, np.zeros(n, bool)]
    names = [x.split()[0] for x in substring_dedup.RUN_SCHEMA.split(", ")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 9_000]) for c in columns], names=names) for k in range(0, n, 9_000)]
    packed = list(substring_dedup.refined(iter(batches), 8))
    assert sum(b.num_rows for b in packed) <= 8 * len(packed) and len(packed) <= 1 + n // substring_dedup.KEYS
    first = np.full(60_000, 500)
    np.minimum.at(first, bucket, doc)
    later = doc > first[bucket]
    table = pa.Table.from_batches(packed).sort_by("group").to_batches()
    rows = [r for b in substring_dedup.by_row(iter(table), "done", "todo") for r in b.to_pylist()]
    assert len({r["_doc"] for r in rows}) == len(rows) and all(r["_row"] == 7 * r["_doc"] and not r["todo"] for r in rows)
    assert sorted((r["_doc"], x) for r in rows for x in r["done"]) == sorted(zip(doc[later].tolist(), span[later].tolist(), strict=True))


def test_texts_are_stored_once(spark, odd, monkeypatch):
    seen, plain = [], substring_dedup.bucketed
    monkeypatch.setattr(substring_dedup, "bucketed", lambda df, *a: seen.append(df.schema) or plain(df, *a))
    kept = substring_dedup.without_repeats(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.where("text IS NULL").collect()} == {r.doc_id for r in odd.where("text IS NULL").collect()}
    assert seen[0].simpleString().count("text:") == 1


def test_tables_of_a_step_go_with_it(spark):
    there = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    found = lambda path: path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    with common.scratch(spark):
        with common.step(spark):
            gone, stays = there(common.materialize(spark.range(3), "gone")), there(common.materialize(spark.range(3), "stays", keep=True))
            assert found(gone) and found(stays)
        assert not found(gone) and found(stays)
        kept = there(common.materialize(spark.range(3), "kept", keep=True))
    assert not found(stays) and found(kept)


def test_an_empty_scope_ends_alone(spark):
    with common.scratch(spark):
        outer = common._scopes[-1]
        with common.scratch(spark):
            pass
        assert common._scopes[-1] is outer


def test_the_fit_takes_every_word_of_every_text(spark):
    path = tokens.vocabulary("piece_bpe_32k.model")
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "then", "there", "ion", "straße", "\u2603x"]) for _ in range(rng.randint(1, 30))) for _ in range(700)]
    texts += ["x " * 6000 + "zebra", "  two  spaces ", None, "", "一二三" * 200 + "\u2603" * 80]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own, words = nbest.Lattice(path), Counter()
    for t in filter(None, texts):
        for w in nbest.SEGMENT.findall(nbest.MARK + t.replace(" ", nbest.MARK)):
            words.update([w] if len(w) <= nbest.LONGEST else own.parts(w))
    found, expect = (nbest.fitted(df.repartition(k), path, 3) for k in (1, 5))
    assert (found == expect).all() and np.allclose(found, own.fit(words), rtol=0, atol=1e-9)
    assert found[own.pieces[nbest.MARK + "x"][0]] > -1.5  # 6,000 words beyond any prefix


def test_expected_counts_against_all_segmentations():
    own = nbest.Lattice(tokens.vocabulary("piece_bpe_32k.model"))
    words, scores = {nbest.MARK + "there": 3, nbest.MARK + "a\u2603n": 2, nbest.MARK: 1}, np.random.default_rng(2).normal(-8, 2, len(own.sizes))
    low, plain = scores[own.known_ids()].min() - nbest.UNKNOWN, np.zeros(len(own.sizes))
    for w, c in words.items():
        spans = own.spans(w)
        spans += [(i, i + 1, -1) for i in range(len(w)) if (i, i + 1) not in {(x, y) for x, y, _ in spans}]
        def paths(i):
            return [[]] if i == len(w) else [[s, *rest] for s in spans if s[0] == i for rest in paths(s[1])]
        weights = [(np.exp(sum(scores[k] if k >= 0 else low for *_, k in path)), path) for path in paths(0)]
        for weight, path in weights:
            for *_, k in path:
                if k >= 0:
                    plain[k] += c * weight / sum(x for x, _ in weights)
    found = own.expected(own.edges(list(words)), np.array(list(words.values()), float), scores) / nbest.UNIT
    assert np.allclose(found, plain, rtol=0, atol=1e-4) and plain.sum() > 6


def test_chunks_of_letters_and_signs_share_their_words():
    own = tokens.Encoder(tokens.vocabulary())
    rng = random.Random(5)
    texts = ["zu alpha alpha, alpha.\nalpha? alpha; (alpha) alpha."] + ["".join(rng.choice("abÉɏɐªº .,,..\n\n'’\"0²½漢-_#*\u0085\x1c!¡«") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, at = own.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
    one = tokens.Encoder(tokens.vocabulary())
    one.encode(pa.array(texts[:1]))
    assert set(one.cache) == {" zu", " alpha", "alpha"}


def test_a_task_lets_go_of_caches_that_others_left():
    kept = common.worker_cache("encoders")
    kept["x"] = 1
    assert list(common.tidy(iter([1]), "encoders")) == [1] and kept == {"x": 1}
    assert list(common.tidy(iter([1]))) == [1] and not kept


def test_segments_share_their_parts():
    own = nbest.Lattice(tokens.vocabulary("piece_bpe_32k.model"))
    list(own.encode_all(pa.array(["zu ofering, ofering.\nofering ofering?"])))
    assert {nbest.MARK + "ofering", ",", "\n"} <= set(own.cache) and not any("," in x and len(x) > 1 for x in own.cache)
    counts = Counter()
    for b in nbest.counted_words(iter([pa.RecordBatch.from_pydict({"text": ["zu ofering, ofering.", "ofering"]})]), own):
        counts.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert counts == {nbest.MARK + "zu": 1, nbest.MARK + "ofering": 3, ",": 1, ".": 1}


def test_expected_counts_beyond_the_range_of_products():
    own, rng = nbest.Lattice(tokens.vocabulary("piece_bpe_32k.model")), np.random.default_rng(3)
    scores = rng.normal(-40, 9, len(own.sizes))
    names = ["there" * 12, nbest.MARK + "the", "\u2603" * 60, "ion"]
    edges = own.edges(names)
    size, step, length, piece = edges
    start, low = np.cumsum(step), scores[own.known_ids()].min() - nbest.UNKNOWN
    whose = np.repeat(np.arange(4), size)[start]
    logs = own.by_logarithms(size, start, length, whose, np.where(piece < nbest.OTHER, scores[np.where(piece < nbest.OTHER, piece, 0)], low))
    assert np.abs(np.bincount(piece[piece < nbest.OTHER], logs[piece < nbest.OTHER], len(own.sizes)) - own.expected(edges, np.ones(4), scores) / nbest.UNIT).max() < 1e-4


def test_texts_are_cut_at_once_where_no_piece_joins_letters():
    path, rng = tokens.vocabulary("piece_bpe_32k.model"), random.Random(7)
    own, small = nbest.Lattice(path), nbest.Lattice(path, limit=16)
    texts = ["", "".join(map(chr, range(0x4E00, 0x4E40))), nbest.MARK, " ", "  x ", "", "\0 \0", "\u2603" * 70 + "é" * 70, ""]
    texts += ["".join(rng.choice("theaion .,\n\0é一三\U0001f600живש▁") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for some in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array(["", ""]), pa.array([], pa.string())):
        parts, first = own.cut_all(some)
        found = [parts.slice(i, j - i).to_pylist() for i, j in zip(first[:-1], first[1:], strict=True)]
        marked = [nbest.MARK + t.replace(" ", nbest.MARK) if t else "" for t in some.to_pylist()]
        cuts = [[k for k in range(1, len(m)) if m[k - 1 : k + 1] not in own.pairs] for m in marked]
        assert found == [[m[i:j] for i, j in zip([0, *c], [*c, len(m)], strict=True)] if m else [] for m, c in zip(marked, cuts, strict=True)]
    assert len(own.parts(texts[1])) > 1  # letters, most pairs of which no piece has
    expect = list(own.encode_all(pa.array(texts)))
    assert [x for t in texts for x in small.encode_all(pa.array([t]))] == expect and len(small.cache) + len(small.older) < 140
    assert list(small.encode_all(pa.array(texts))) == expect
    assert list(nbest.slices(pa.array(["abc", "", "de", "f" * 9, "g"]), 5)) == [(0, 3), (3, 4), (4, 5)]
