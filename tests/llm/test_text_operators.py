from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import decontaminate, fingerprint, licenses, neardup, quality, token_orc
from tests.llm.conftest import PASSAGE

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- fingerprints


@given(st.text(max_size=60), st.text(max_size=60), st.data())
@settings(max_examples=60, deadline=None)
def test_spans_and_extensions(a, b, data):
    x, y = fingerprint.PrefixHashes(a), fingerprint.PrefixHashes(b + a)
    i = data.draw(st.integers(0, len(a)))
    j = data.draw(st.integers(0, len(a + b)))
    want = next((k for k in range(min(len(a) - i, len(a + b) - j)) if a[i + k] != (b + a)[j + k]), min(len(a) - i, len(a + b) - j))
    assert x.extension(i, y, j) == want
    assert x.span(0, len(a)) == y.span(len(b), len(a + b))


def test_sketch_of_long_texts_is_as_of_short_ones(monkeypatch):
    text = "".join(chr(97 + (k * k) % 23) for k in range(5000))
    whole = fingerprint.sketch(text)
    monkeypatch.setattr(fingerprint, "CHUNK", 512)
    parts = fingerprint.sketch(text)
    assert whole[:2] == parts[:2] and (whole[2] == parts[2]).all()
    assert fingerprint.read(fingerprint.written(whole))[1] == whole[1]


def test_fingerprints_of_documents(spark, documents, rows):
    got = fingerprint.fingerprint_documents(spark, documents).collect()
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    prints = {}
    for k, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(k + 1) % len(ordered)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        found = [g for g in by_id[r[0]] if g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert found and found[0].n_chars == len(text)
        assert 0 <= found[0].near_edited <= 1 and 0 <= found[0].near_next <= 1
        prints.setdefault(text, set()).add(found[0].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({*map(tuple, prints.values())}) == len(prints)


def _plain_cover(a, b):
    """The code points of a that left-to-right maximal matches with b cover, by plain searches."""
    n = min(fingerprint.SPAN, len(a))
    starts = list(range(0, len(a) - n + 1, n)) if n and len(b) >= n else []
    if starts and starts[-1] + n < len(a):
        starts.append(len(a) - n)
    covered, reached = set(), 0
    for i in starts:
        j = b.find(a[i : i + n])
        if j < 0 or i + n <= reached:
            continue
        left = right = 0
        while left < min(i, j) and a[i - 1 - left] == b[j - 1 - left]:
            left += 1
        while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
            right += 1
        reached = i + right
        covered |= set(range(i - left, reached))
    return len(covered)


def _plain_likeness(a, b):
    return 1.0 if a == b else (_plain_cover(a, b) + _plain_cover(b, a)) / (len(a) + len(b))


@given(st.lists(st.sampled_from(["the of and ", "alpha", "beta ", "gamma delta ", "é日𝒳", "lorem ipsum dolor "]), max_size=25), st.lists(st.sampled_from(["the of and ", "alpha", "x", "gamma delta "]), max_size=25), st.data())
@settings(max_examples=120, deadline=None)
def test_likeness_as_plain_searches(one, other, data):
    a = "".join(one)
    b = a[: data.draw(st.integers(0, len(a)))] + "".join(other)
    x, y = fingerprint.PrefixHashes(a), fingerprint.PrefixHashes(b)
    assert fingerprint.likeness(x, y) == pytest.approx(_plain_likeness(a, b)) == fingerprint.likeness(y, x)
    stop, length = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    joined, whole = fingerprint.PrefixHashes.joined(x, stop, y, length), fingerprint.PrefixHashes(a[:stop] + b[:length])
    assert fingerprint.written(fingerprint.sketch(joined)) == fingerprint.written(fingerprint.sketch(whole))
    at, place = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    back = 0
    while back < min(at, place) and a[at - 1 - back] == b[place - 1 - back]:
        back += 1
    assert x.extension_back(at, y, place) == back


def test_matches_are_maximal_and_true():
    a, b = "zz" + "common run of text that both have " * 3 + "end", "other start common run of text that both have common run of"
    for start, at, length in fingerprint.PrefixHashes(a).matches(fingerprint.PrefixHashes(b)):
        assert a[start : start + length] == b[at : at + length]
        assert not (start and at and a[start - 1] == b[at - 1])
        assert start + length == len(a) or at + length == len(b) or a[start + length] != b[at + length]


@pytest.mark.parametrize("high", [0, 2**60])
def test_every_row_has_its_successor(spark, high):
    """Null ids, ids beyond what a double holds, ids that a third of all rows share, and more partitions than ids."""
    texts = [(None, "null one"), (None, "null two"), (None, None), *((high + 7, f"{k} hot text") for k in range(12)), *((high + k, f"text of {k} " * 5) for k in range(20)), (high + 30, "x" * 50_000), (high + 31, "")]
    for parts in (1, 3):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        got = fingerprint.fingerprint_documents(spark, docs).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == sorted((d is not None, d or 0, len(t or "")) for d, t in texts)
        hashed = docs.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()
        ring = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
        want = []
        for (doc, text), (_, after) in zip(ring, ring[1:] + ring[:1]):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            want.append((doc or -1, hashlib.sha256(edited.encode()).hexdigest(), pytest.approx(_plain_likeness(text, edited)), pytest.approx(_plain_likeness(text, after))))
        assert sorted(((r.doc_id or -1, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])


# --- licenses


def test_licenses_as_a_plain_scan(spark, documents, rows):
    got = {r.doc_id: r for r in licenses.summarise(licenses.scan_licenses(spark, documents)).collect()}
    for doc, text, *_ in rows:
        w, starts, labels = words(text), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        r = got[doc]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(starts), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_longer_templates_need_their_key_phrase(spark):
    docs = spark.createDataFrame([(1, "xx Redistribution and use in source and binary forms, with or without modification, are permitted"), (2, "redistribution and use without modification are permitted")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.summarise(licenses.scan_licenses(spark, docs)).collect()}
    assert got == {1: "bsd", 2: ""}


def _plain_labels(w, weight):
    """The added labels by trying every start: the share of the rarest words' weight, and the key phrase at its place."""
    out = set()
    for label, text, key in licenses.TEMPLATES:
        p, inner = text.split(), key.split()
        offset = " ".join(p).split(key)[0].count(" ")
        voters = sorted(range(len(p)), key=lambda k: (-weight[p[k]], k))[: licenses.VOTERS]
        whole = sum(weight[p[k]] for k in voters)
        for start in range(-len(p), len(w)):
            at = start + offset
            if at >= 0 and w[at : at + len(inner)] == inner:
                share = sum(weight[p[k]] for k in voters if 0 <= start + k < len(w) and w[start + k] == p[k]) / whole
                if share >= licenses.AGREE - 1e-9:
                    out.add(label)
    return out


def test_added_labels_as_every_start(spark):
    """Whole and damaged templates, key phrases far from them, capitals, words in other scripts, long and null texts."""
    import math
    import random

    rng = random.Random(8)
    texts = [None, "", "MIT", "Ünder the mit license", "redistribution and use with or without modification are permitted " + "word " * 200 + "source and binary forms", "x " * 30_000 + "GNU Affero General Public License as published by the Free Software Foundation"]
    for _, text, _ in licenses.TEMPLATES:
        for _ in range(6):
            w = text.split()
            for at in rng.sample(range(len(w)), rng.randint(0, 4)):
                w[at] = rng.choice(["other", "the", "license"])
            texts.append(" ".join(rng.choice(["", "é,", "some words. "]) + x for x in w).upper() if rng.random() < 0.3 else "before " * rng.randint(0, 3) + " ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = [words(t) for t in texts]
    seen = {w: sum(w in x for x in every) for w in licenses._vocabulary()}
    weight = {w: math.log((len(texts) + 1) / (n + 0.5)) for w, n in seen.items()}
    got = licenses.summarise(licenses.scan_licenses(spark, docs)).collect()
    for r in got:
        w = every[r.doc_id]
        base = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {' '.join(w)} "}
        assert (r.n_words, set(filter(None, r.labels.split(",")))) == (len(w), base | _plain_labels(w, weight)), texts[r.doc_id]
    assert "bsd" not in got[4].labels and sum(r.labels != r.base_labels for r in got) > 20


# --- tokens


def test_units_encode_as_whole_texts(rows):
    import public_tokenizers

    encoder = token_orc.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a  b", "a\n\n\nb", " lead", "trail ", "x\x01y", "it's 4.0, ok...", "a b \x1c c", "\n a", "A.B,C !?", "<|endoftext|>", "é́x 日本 語"]
    for text in [*odd, *(r[1] or "" for r in rows)]:
        assert encoder.encode(text) == encoder.whole(text), text[:50]


@given(st.text(alphabet="ab ,.\n!' é4", max_size=40))
@settings(max_examples=150, deadline=None)
def test_units_encode_any_text(text):
    import public_tokenizers

    encoder = token_orc._encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode(text) == encoder.whole(text)


def test_units_encode_as_the_library_by_default():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder, mark = Tokenizer.from_file(path), token_orc._encoder(path), "<|endoftext|>"
    assert library.encode(mark, add_special_tokens=False).ids == [50256]
    texts = [f.replace("@", mark) for f in ("foo @ bar", "@", "a@b", "a @", "@ b", "x.@", "@.", "@,a.b,c", "a\n@\nb", "a  @  b", "@@ @", "\n\n@ a", "_@_.", "a\t@\tb", "<@>", "a. @ b, c")] + ["<|endof text|>", "< |endoftext|>"]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark, documents, rows):
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    path = token_orc.tokens_path(spark)
    token_orc.write_tokens(spark, documents, vocabulary, path)
    got = sorted(token_orc.digest_tokens(spark, path).collect(), key=lambda r: (r.doc_id, r.start))
    start = 0
    for r, (doc, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0], r[1] or "")), strict=True):
        ids = token_orc._encoder(vocabulary).whole(text or "") + np.array([2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert token_orc.read_tokens(spark, path).filter("doc_id = 5").count() == 1


# --- decontamination


def test_contamination_as_a_plain_search(spark, documents, rows, benchmark):
    got = {r.doc_id: r for r in decontaminate.mark_contaminated(spark, documents, benchmark).collect()}
    items = [(str(i) if i is not None else None, words(t)) for i, t in [(1, PASSAGE), (2, "short item here"), (None, PASSAGE)]]
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for item, x in items:
            n = min(13, len(x))
            for k in range(len(x) - n + 1):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == x[k : k + n]:
                        hit |= set(range(at, at + n))
                        found.add(item)
        r = got[doc]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r["items"] == sorted(x for x in found if x is not None)
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_longest_matches_and_removal(spark, documents, rows, benchmark):
    found = decontaminate.longest_matches(spark, documents, benchmark).filter("item_id = '1'").collect()
    assert {(r.item_word, r.n_words, r.doc_id, r.doc_word) for r in found} == {(0, 20, 14, 50)}
    kept = decontaminate.decontaminate(spark, documents, benchmark)
    assert kept.columns == documents.columns and kept.count() == len(rows) - 1


def test_suffix_array_orders_and_bisects():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 3, 400).astype(np.int32)
    array = decontaminate.SuffixArray(text, 6, 2)
    for n in (2, 3, 4):
        for k in range(0, 380, 7):
            pattern = tuple(text[k : k + n].tolist())
            if 0 not in pattern:
                assert sorted(array.places(pattern).tolist()) == [i for i in range(len(text) - n + 1) if tuple(text[i : i + n].tolist()) == pattern]


def _plain_matches(w, items, window):
    """Longest verbatim matches (item number, its word, length, document word) of at least a window, word by word."""
    out = set()
    for k, x in enumerate(items):
        least = min(window, len(x))
        for i in range(len(x)):
            for j in range(len(w)):
                if i and j and x[i - 1] == w[j - 1]:
                    continue
                n = 0
                while i + n < len(x) and j + n < len(w) and x[i + n] == w[j + n]:
                    n += 1
                if least and n >= least:
                    out.add((k, i, n, j))
    return out


@pytest.mark.parametrize(("part_words", "shard_words", "window"), [(5, 40, 3), (30, 7, 4), (10**6, 10**6, 2), (12, 1, 5)])
def test_parts_and_shards_as_plain_matches(spark, monkeypatch, part_words, shard_words, window):
    """A benchmark of many parts, shards over many batches, documents longer than a shard, and passages that many documents share."""
    import random

    rng = random.Random(part_words + window)
    monkeypatch.setattr(decontaminate, "PART_WORDS", part_words)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard_words)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, "a " * 60, "x y z"]
    bench = [(f"i{k % 9}", " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))) for k in range(12)] + [("i0", None), ("i10", "a a a a a a a")]
    items = [words(t) for _, t in bench]
    # The same code as the executors', here on one iterator of small batches.
    tests = decontaminate._test_set(spark, spark.createDataFrame(bench, "item_id string, text string"), window)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t or "" for t in texts])], names=["doc_id", "text"])
    batches = [batch.slice(k, 4) for k in range(0, len(texts), 4)]
    marks = [r for b in decontaminate._marks(tests)(iter(batches)) for r in b.to_pylist()]
    places = [r for b in decontaminate._locations(tests)(iter(batches)) for r in b.to_pylist()]
    clean = [r for b in decontaminate._clean(tests)(iter(batches)) for r in b.to_pylist()]
    want_places, want_clean = [], []
    for doc, text in enumerate(texts):
        w = words(text)
        found = _plain_matches(w, items, window)
        want_places += [(bench[k][0], i, n, doc, j) for k, i, n, j in found]
        hit = {x for _, _, n, j in found for x in range(j, j + n)}
        names = sorted({bench[k][0] for k, *_ in found})
        assert marks[doc] == {"doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(names), "items": names}
        if not hit or 20 * len(hit) < len(w):
            want_clean.append(doc)
    assert sorted(tuple(r.values()) for r in places) == sorted(want_places)
    assert [r["doc_id"] for r in clean] == want_clean


# --- near duplicates


def _plain_components(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.setdefault(doc, set()).add(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}, {i: max(map(len, s)) for i, s in sets.items()}


def test_near_duplicates_as_all_pairs(spark, documents, rows):
    want, sizes = _plain_components(rows)
    got = neardup.link_documents(spark, documents).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] and r.n_shingles == sizes[r.doc_id] for r in got)


def test_links_hold_to_the_limit_given(spark):
    base = [f"w{k}" for k in range(100)]
    near = base[:98] + ["x1", "x2"]  # 94 of 98 shingles are common
    far = base[:92] + [f"y{k}" for k in range(8)]  # 88 of 104
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(far)), (3, " ".join(near))], "doc_id long, text string")
    label = lambda *limit: {r.doc_id: r.component_id for r in neardup.link_documents(spark, docs, *limit).collect()}
    assert label() == {1: 1, 2: 2, 3: 1} and label((80, 100)) == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id for r in neardup.drop_near_duplicates(spark, docs, (80, 100)).collect()} == {1}


def test_groups_of_near_copies(spark):
    import random

    rng = random.Random(9)
    rows, doc = [], 0
    for _ in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
        for _ in range(20):
            w = list(base)
            for at in rng.sample(range(150), rng.randint(0, 5)):
                w[at] = f"e{rng.randint(0, 10**6)}"
            rows.append((doc, " ".join(w)))
            doc += 1
    rng.shuffle(rows)
    want, _ = _plain_components(rows)
    got = neardup.link_documents(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    kept = neardup.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:2400], rng.integers(0, 2**63, 400).astype(np.uint64)]))
    x, y, both = neardup.sketch([a, b, np.union1d(a, b)])
    assert (neardup.merge(x, y) == both).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(neardup.estimate(x[None], y[None], np.array([float(len(a))]), np.array([float(len(b))]))[0] - true) < 0.12


# --- quality


def test_quality_on_held_out_rows(spark):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for k in range(1200):
        good = k % 3 > 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
        text = ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, len(w), 9)) if good else " ".join(w[:6] * 8).upper() + "!!"
        rows.append((k, text))
        labels.append((k, int(good), 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.score_documents(spark, docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    kept = quality.keep_good(spark, docs, marks)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(4)
    x = np.sort(rng.random(200))
    middles, values = quality.isotonic(x, (rng.random(200) < x).astype(float), np.ones(200))
    assert (np.diff(values) > 0).all() and (np.diff(middles) > 0).all()


def test_quality_without_labels(spark, documents, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(spark, documents, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(spark, documents, one).collect()} == {1.0}


# --- odd tables


@pytest.mark.parametrize("table", ["empty", "clashing"])
def test_odd_tables(spark, table, request, rows, benchmark):
    import public_tokenizers

    docs = request.getfixturevalue(table)
    n = 0 if table == "empty" else len(rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    path = token_orc.tokens_path(spark)
    token_orc.write_tokens(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    assert token_orc.digest_tokens(spark, path).count() == n
    assert fingerprint.fingerprint_documents(spark, docs).count() == n
    assert licenses.summarise(licenses.scan_licenses(spark, docs)).count() == n
    assert quality.score_documents(spark, docs, labels).count() == n
    assert decontaminate.mark_contaminated(spark, docs, benchmark).count() == n
    assert neardup.link_documents(spark, docs).count() == n
    assert neardup.drop_near_duplicates(spark, docs).columns == docs.columns
    assert decontaminate.mark_contaminated(spark, docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


def test_groups_end_where_their_keys_change():
    """Groups over many batches, batches of many groups and empty batches come as whole groups, in order."""
    rng = np.random.default_rng(5)
    keys = sorted((int(rng.integers(0, 9)), int(rng.integers(0, 3)), int(rng.integers(0, 2))) for _ in range(300))
    whole = pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys]) for i in range(3)] + [pa.array(range(300))], names=["band", "low", "high", "node"])
    for size in (1, 2, 7, 50, 300):
        batches = [whole.slice(a, size) for a in range(0, 300, size)]
        tables = list(neardup._groups(iter([whole.slice(0, 0), *batches, whole.slice(0, 0)])))
        assert [x for t in tables for x in t.column("node").to_pylist()] == list(range(300))
        ends = [tuple(t.column(k)[-1].as_py() for k in ("band", "low", "high")) for t in tables]
        starts = [tuple(t.column(k)[0].as_py() for k in ("band", "low", "high")) for t in tables]
        assert all(a != b for a, b in zip(ends, starts[1:]))
