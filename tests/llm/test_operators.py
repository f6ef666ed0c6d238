"""Each operator against a plain version, and on odd and empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querydelta.llm import (
    batches, bpe, chunks, components, decontaminate, langid, licences, neardup, packing, pii, quality, sharding, shingles,
)
from querydelta.llm.scratch import Scratch

SMALL = "/root/testdata/sf0.001"
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "'", "s", "re", "ll", " ", "  ", "\n", " ", "\x1c", "é", "12", "!", "日本", "🙂", "x" * 70, "<|endoftext|>"]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {row.doc_id: row.text for row in docs.select("doc_id", "text").collect()}


def strange(n, length=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, length))) for _ in range(n)]


def test_tree_encodes_like_the_library():
    tree = bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN, leaf_chars=3)
    for text in strange(500):
        ids = tree.encode(text)
        assert ids.tolist() == tree.leaf.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


def test_pieces_encode_like_the_library():
    own = packing.PieceEncoder(JSON)
    found = [ids.tolist() for ids in own.encode(strange(300, seed=2))]
    assert found == [own.library.encode(text, add_special_tokens=False).ids for text in strange(300, seed=2)]


def test_pieces_of_a_full_cache_and_of_any_white_space():
    own = packing.PieceEncoder(JSON, cache_pieces=40)
    spaces = [space.decode() for space in packing._SPACES]
    rng = random.Random(3)
    made = ["".join(rng.choice([*PIECES, *spaces]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for first in range(0, 200, 20):
        ids, bounds = own.encode_column(pa.array(["", *made])[1:][first : first + 20])
        found = [part.tolist() for part in np.split(ids, bounds[1:-1])]
        assert found == [own.library.encode(text, add_special_tokens=False).ids for text in made[first : first + 20]]
        assert len(own.known) == len(own.sizes) <= 40 and own.sizes.sum() == len(own.ids)


def test_a_full_cache_keeps_the_pieces_at_hand():
    own, asked = packing.PieceEncoder(JSON, cache_pieces=4), []
    ask = own._ask
    own._ask = lambda pieces, inner: asked.append(pieces.to_pylist()) or ask(pieces, inner)
    for text in (" one two three", " two three four five", " two three four five"):
        own.encode([text])
    assert asked == [[b" one", b" two", b" three"], [b" four", b" five"], []]


def test_slices_of_a_column():
    column = pa.array(["", "ab", "cdefg", "", "h", "ij"])
    assert [part.to_pylist() for part in packing.byte_slices(column, 3)] == [["", "ab"], ["cdefg"], ["", "h", "ij"]]
    assert list(packing.byte_slices(column[:0], 3)) == []


@pytest.mark.parametrize("bits", [1, 5, 8, 16, 17, 24, 31])
def test_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    packed = packing.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (packing.unpack(packed, bits, 1001) == ids).all()
    assert (packing.unpack(packed, bits, 100, 333) == ids[333:433]).all()


def test_token_files(spark, odd, empty):
    folder = Scratch(spark).path("tokens")
    packing.write_token_files(odd, folder, JSON, 2, block_ids=50)
    rows = sorted(packing.read_documents(spark, folder).collect(), key=lambda row: row.start)
    ordered = sorted(odd.collect(), key=lambda row: (row.doc_id is not None, row.doc_id or 0, row.text or ""))
    library, start = packing.piece_encoder(JSON).library, 0
    for row, doc in zip(rows, ordered, strict=True):
        ids = [*library.encode(doc.text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc.doc_id, start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    parts = sorted(packing.read_range(spark, folder, 7, 90).collect())
    assert parts[0].start == 7 and sum(len(part.ids) for part in parts) == 90
    folder = Scratch(spark).path("none")
    packing.write_token_files(empty, folder, JSON, 2)
    assert packing.read_documents(spark, folder).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", match.group())
            good = {
                "email": True, "ip": all(int(part) <= 255 for part in match.group().split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and pii._luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((match.start(), match.end(), kind))
    return sorted(out, key=lambda span: (span[0], pii.KINDS.index(span[2])))


def test_base_spans():
    rng = random.Random(4)
    parts = ["1", "9", ".", "@", "+", "-", " ", "a", "b_", "(", ")", "é", "4111111111111111", "10.0.0.1", "a@b.co", "+1 (212) 555-0100"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_tagger_gradients_and_reconciliation():
    rng, tagger = np.random.default_rng(0), pii.Tagger.new()
    ids, tags = rng.integers(0, 130, (3, 9)), rng.integers(0, 9, (3, 9))
    _, slopes = tagger.gradients(ids, tags)
    for name, place in (("move", (1, 2)), ("ahead_rec", (3, 5)), ("back_in", (2, 7)), ("embed", (ids[0, 3], 1)), ("out", (4, 4))):
        value = tagger.p[name][place]
        ends = []
        for step in (1e-5, -1e-5):
            tagger.p[name][place] = value + step
            ends.append(tagger.gradients(ids, tags)[0])
        tagger.p[name][place] = value
        assert abs((ends[0] - ends[1]) / 2e-5 - slopes[name][place]) < 1e-6
    chosen = pii.reconcile({(0, 5, "ip"): 2.0, (4, 9, "ip"): 3.0, (9, 12, "ip"): 1.0, (20, 25, "ip"): 9.0}, [(22, 30, "card")])
    assert sorted(chosen) == [(4, 9, "ip"), (9, 12, "ip")]


class _WordTagger(pii.Tagger):
    """Scores every character of a word as inside an address, and sees no more than its window."""

    def emissions(self, ids):
        out = np.zeros((ids.shape[1], ids.shape[0], len(pii.TAGS)))
        out[:, :, 2] = np.where(ids.T > 32, 5.0, -5.0)
        return out


@pytest.mark.parametrize("length", [20, 40, 50, 64, 200])
def test_spans_reach_over_windows(length):
    plain = pii.Tagger.new()
    tagger = _WordTagger(plain.p | {"move": np.zeros_like(plain.p["move"])})
    local = (length - 10) // 2
    address = "a" * local + "@" + "ü" * (length - local - 4) + ".de"
    assert len(address) == length and not pii.base_spans(address)
    for offset in range(70):
        text = " " * offset + address + " " * 100
        assert tagger.spans([text, text], [[], []]) == [[(offset, offset + length, "email")]] * 2, offset


def test_stretches_decode_alike_alone_and_together():
    tagger, texts = pii.fit(np.zeros((0, 64), np.uint8), np.zeros((0, 64), np.uint8)), strange(60, length=40, seed=9)
    base = [pii.base_spans(text) for text in texts]
    alone = [tagger.spans([text], [own], per_call=1)[0] for text, own in zip(texts, base, strict=True)]
    assert tagger.spans(texts, base) == alone
    sizes = [5, 1, 9, 5]
    scores = np.random.default_rng(1).normal(0, 1, (20, len(pii.TAGS)))
    tags, _ = tagger.decode(scores, sizes)
    parts = np.split(scores, np.cumsum(sizes)[:-1])
    assert tags.tolist() == [tag for part in parts for tag in tagger.decode(part, [len(part)])[0].tolist()]


def test_personal_data(odd, empty):
    rows = pii.find_personal_data(odd).collect()
    assert collections.Counter((row.doc_id, row.base) for row in rows) == collections.Counter(
        (doc.doc_id, pii.joined(pii.base_spans(doc.text or ""))) for doc in odd.collect()
    )
    clean = pii.redact_documents(odd).collect()
    assert clean[0].text.endswith("mail [EMAIL] or [PHONE].") and clean[0].n_chars == len(clean[0].text)
    assert clean[2].text is None and pii.find_personal_data(empty).count() == 0


def test_bpe_documents(odd, empty):
    rows = bpe.encoded_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert [row.decoded_sha256 for row in rows] == [hashlib.sha256((doc.text or "").encode()).hexdigest() for doc in odd.collect()]
    decoded = bpe.decode_documents(bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert [bytes(row.decoded) for row in decoded.collect()] == [(doc.text or "").encode() for doc in odd.collect()]
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_hash_tree(spark, odd, empty):
    tree = sharding.even_tree(24)
    ids = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.shard_documents(ids, tree, tree.with_region([[(24, 1.0)]]), rows_per_task=20).collect()
    sizes = collections.Counter(row.shard for row in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 2 * min(sizes.values())
    assert all(row.grown_shard in (row.shard, 24) for row in rows) and any(row.grown_shard == 24 for row in rows)
    for shard in range(24):
        assert sorted(row.slot for row in rows if row.shard == shard) == list(range(sizes[shard]))
    heavier = sharding.Tree((tree.regions[0], tree.regions[1], (tree.regions[2][0], ((20, 3.0), *tree.regions[2][1][1:]))))
    moved = sharding.shard_of(sharding.shard_of(ids, F.col("doc_id"), tree, "old"), F.col("doc_id"), heavier, "new")
    changed = moved.where("old != new").select("old", "new").distinct().collect()
    assert changed and all(row.new >= 16 for row in changed)
    found = sharding.shard_documents(odd, tree).collect()
    assert collections.Counter((row.doc_id, row.size, row.text_crc32) for row in found) == collections.Counter(
        (doc.doc_id, len((doc.text or "").encode()) + 8, zlib.crc32((doc.text or "").encode())) for doc in odd.collect()
    )
    assert sharding.shard_documents(empty, tree).count() == 0


def test_fingerprints(docs, texts, odd, empty):
    rows = {row.doc_id: row for row in chunks.fingerprint_documents(docs).collect()}
    order = sorted(texts, reverse=True)
    for own, following in zip(order, [*order[1:], order[0]], strict=True):
        text, third = texts[own], len(texts[own]) // 3
        edited = text[: len(text) - third] + texts[following][:third]
        row = rows[own]
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and row.n_chars == len(text)
        assert row.fingerprint == chunks.fingerprint(chunks.chunk_set(text))
        assert row.near_edited == chunks.containment(chunks.chunk_set(text), chunks.chunk_set(edited))
        assert row.near_next == chunks.containment(chunks.chunk_set(text), chunks.chunk_set(texts[following]))
    data = "".join(texts.values()).encode()[:200_000]
    shifted = {data[a:b] for a, b in zip([0, *chunks.chunk_ends(data)], chunks.chunk_ends(data), strict=False)}
    moved = b"new start " + data
    again = {moved[a:b] for a, b in zip([0, *chunks.chunk_ends(moved)], chunks.chunk_ends(moved), strict=False)}
    assert len(shifted & again) > 0.98 * len(shifted)
    assert chunks.fingerprint_documents(odd).count() == odd.count() and chunks.fingerprint_documents(empty).count() == 0


def _similarity(one, two, weight):
    one, two = collections.Counter(one), collections.Counter(two)
    low = sum(min(one[x], two[x]) * weight(x) for x in one | two)
    return low / sum(max(one[x], two[x]) * weight(x) for x in one | two)


def test_decontamination(spark, docs, texts, odd, empty):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {row.item_id: row.text for row in benchmark.collect()}
    found = {(row.doc_id, row.item_id): row.similarity for row in decontaminate.find_passages(docs, benchmark).collect()}
    words = lambda text: re.sub(r"[\x00-\x7f]", lambda c: c.group().lower() if c.group().isalnum() else " ", text).split()
    runs = lambda w: [tuple(w[at : at + 5]) for at in range(max(1, len(w) - 4))]
    own = {item: runs(words(text)) for item, text in items.items()}
    held = collections.Counter(shingle for item in own.values() for shingle in set(item))
    weight = lambda shingle: np.log1p(len(items) / held.get(shingle, 1))
    for doc_id, text in texts.items():
        split = words(text)
        every = set(runs(split))
        for item, wanted in own.items():
            best = 0.0
            if every & set(wanted):
                size = len(words(items[item]))
                best = max(
                    _similarity(runs(split[at : at + size]), wanted, weight) for at in range(max(1, len(split) - size + 1))
                )
            assert (best >= 0.75) == ((doc_id, item) in found), (doc_id, item, best)
    assert found
    in_parts = decontaminate.find_passages(docs, benchmark, per_pass=7)
    assert {(row.doc_id, row.item_id) for row in in_parts.collect()} == set(found)
    assert decontaminate.drop_contaminated(docs, benchmark).count() == len(texts) - len({doc for doc, _ in found})
    assert decontaminate.find_passages(odd, benchmark).count() == 0
    assert decontaminate.find_passages(empty, benchmark).count() == 0
    assert decontaminate.find_passages(odd, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, benchmark.limit(0)).count() == odd.count()


def test_decontamination_does_not_depend_on_the_pass_size(spark, odd):
    rng = random.Random(5)
    common = [" ".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(3)]
    items = [(n, f"{common[n % 3]} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))) for n in range(60)]
    items += [(60, None), (61, "")]
    docs = [(n, " ".join(["before", *text.split()[: 24 - n % 4], "after", "it"])) for n, text in items[:60]]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    texts = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.find_passages(texts, benchmark).collect()))
    parts = sorted(map(tuple, decontaminate.find_passages(texts, benchmark, per_pass=7).collect()))
    assert whole and parts == whole
    kept = decontaminate.drop_contaminated(texts, benchmark, per_pass=7).count()
    assert kept == len(docs) - len({row[0] for row in whole})


def test_licences(spark, odd, empty):
    rows = [(1, "Nothing"), (2, "RELEASED   under (the) mit-license!\nand more prose of another kind follows here"), (3, None)]
    found = {row.doc_id: row for row in licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[2].licence == "mit" and found[2].dice == 1.0 and found[2].licences == ["mit"]
    assert found[1].n_notices == found[3].n_notices == 0 and found[3].licence is None
    assert licences.scan_licences(odd).count() == odd.count() and licences.scan_licences(empty).count() == 0


def test_licences_whatever_the_line_breaks(spark):
    def wrapped(text, width=50):
        return textwrap.fill(" ".join(text.split()), width)

    prose = "Some prose of another kind that says little about how it may be used and goes on for a while. " * 3
    own, full = licences.TEMPLATES, licences.FULL_TEXTS
    cases = {
        f"Copyright (c) 2020 Someone\n\n{wrapped(full['mit-text'])}\n{prose}": ["mit-text"],
        f"{prose}\n{wrapped(own['bsd'])}\n{prose}": ["bsd"],
        f"{prose}\n{wrapped(own['gpl-3.0-header'])}\n{prose}": ["gpl-3.0-header"],
        f"{prose} Released under the MIT License. {prose}": ["mit"],
        f"{wrapped(full['bsd-2-clause-text'])}\n{prose}": ["bsd-2-clause-text"],
        f"{wrapped(full['bsd-3-clause-text'])}\n{prose}": ["bsd-3-clause-text"],
        f"{prose}\n{wrapped(full['isc-text'])}": ["isc-text"],
        f"{prose} Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0. {prose}": ["cc-by-4.0", "cc-by-sa-4.0"],
        f"{wrapped(full['mit-text'])}\nThe text itself is licensed\nunder CC BY 4.0.": ["cc-by-4.0", "mit-text"],
        prose: [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    found = {row.doc_id: row for row in licences.scan_licences(rows).collect()}
    for at, wanted in enumerate(cases.values()):
        assert (found[at].licences, found[at].n_notices) == (wanted, len(wanted)), list(cases)[at]


def test_language_models_keep_every_trigram(spark):
    """More different trigrams than a model once kept of a language."""
    text = "".join(chr(0x4E00 + code) for code in np.random.default_rng(1).integers(0, 20_000, 600_000).tolist())
    codes, ends = langid.letters([text, "aaaa"])
    want = set(langid._ngrams(codes, ends)[0].tolist())
    assert len(want) > 500_000
    found = langid.train(spark.createDataFrame([(text, "x"), ("aaaa", "x"), ("bbb", None)], "text string, lang string"), Scratch(spark))
    assert list(found) == ["x"] and set(found["x"][0].tolist()) == want
    assert found["x"][1].sum() == len(langid._ngrams(codes, ends)[0])


def test_language(spark, docs, odd, empty):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    truth = {row.doc_id: row.lang for row in docs.collect()}
    rows = [row for row in langid.identify_languages(docs, held_out).collect() if row.held_out]
    assert sum(row.lang_pred == truth[row.doc_id] for row in rows) >= 0.95 * len(rows)
    found = langid.identify_languages(odd, held_out).collect()
    texts_of = [doc.text for doc in odd.collect()]
    assert [row.lang_pred == "und" for row in found] == [not any(c.isalpha() for c in text or "") for text in texts_of]
    assert langid.identify_languages(empty, held_out).count() == 0
    counted = langid.train(docs, Scratch(spark))
    models = langid.Models(counted)
    context = models.three.keys[50] >> 21
    keys = (context << 21) | models.one.keys
    at = models.three.places(keys)
    logs = np.where((at >= 0)[:, None], models.three.values[at], models._three(keys))
    assert (np.exp(logs).sum(axis=0) <= 1.0001).all() and (np.exp(logs).sum(axis=0) > 0.99).all()


def test_quality(spark, docs, odd, empty):
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {row.doc_id: row.kept for row in quality.score_documents(docs).collect()}
    assert sum(kept[doc] == (label == 1) for doc, label in labels.items()) >= 0.93 * len(labels)
    rows = quality.score_documents(odd).collect()
    assert all(row.quality == 0 and not row.kept for row, doc in zip(rows, odd.collect(), strict=True) if not (doc.text or "").strip())
    assert quality.score_documents(empty).count() == 0 and quality.drop_junk(empty).columns == empty.columns


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    junk = rng.random(20_000) < 0.2
    n = len(quality.LABELLERS)
    votes = np.where(rng.random((len(junk), n)) < 0.3, -1, np.where(rng.random((len(junk), n)) < 0.85, junk[:, None], ~junk[:, None]))
    numbers, counts = np.unique(quality.pattern_of(votes), return_counts=True)
    model = quality.fit_labels(numbers, counts.astype(float))
    assert abs(model.junk_share - 0.2) < 0.02 and abs(model.chances[1, 0, 2] - 0.7 * 0.85) < 0.04


def plain_components(rows):
    """By all pairs."""
    sets = []
    for text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(at):
        while root[at] != at:
            at = root[at]
        return at

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [find(at) for at in range(len(rows))], [len(own) for own in sets]


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(5)
    rows = []
    for group in range(4):
        words = [f"w{rng.randint(0, 500)}" for _ in range(60)]
        for copy in range(40):
            own = list(words)
            for _ in range(rng.randint(0, 4) if group else copy % 9):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            rows.append(" ".join(own))
    rows += ["a", "A", "a b c d", "a b c d e", "", None, rows[3]]
    rng.shuffle(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    expected, sizes = plain_components(rows)
    found = sorted(neardup.near_duplicates(docs).collect())
    assert [row.component_id for row in found] == expected and [row.n_shingles for row in found] == sizes
    assert [row.kept for row in found] == [at == root for at, root in enumerate(expected)]
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [row.text for row in kept.collect()]
    assert len(texts) == odd.count() - 2 and len([text for text in texts if not (text or "").strip()]) == 3
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_components(spark, odd):
    links = [(at, at + 1) for at in range(1, 60)] + [(100, 300), (300, 200), (7, 7)]
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark), "test").collect()
    roots = dict(found)
    assert all(roots[at] == 1 for at in range(1, 61)) and roots[300] == roots[200] == 100 and len(found) == len(roots)


def test_word_hashes():
    hashes, counts = shingles.PLAIN(["Ab ab  AB\n", "", "é ab", " "])
    assert counts.tolist() == [3, 0, 2, 0] and len(set(hashes[:3].tolist())) == 1 and hashes[4] == hashes[0] != hashes[3]


def test_pipeline(spark, odd):
    import corpus_pipeline

    labels = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.run(spark, SMALL).collect()
    kept = {row.doc_id for row in rows}
    junk_free = {row.doc_id: row.text for row in quality.drop_junk(labels).collect()}
    ids = sorted(junk_free)
    roots, _ = plain_components([junk_free[at] for at in ids])
    single = {own for at, own in enumerate(ids) if roots[at] == at}
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    leaked = {row.doc_id for row in decontaminate.find_passages(labels, benchmark).collect()}
    assert kept == single - leaked and all(row.n_tokens == len(row.ids) for row in rows)
    assert len(corpus_pipeline.STAGES) == 5


def _texts_with_spans(n, seed):
    rng = np.random.default_rng(seed)
    words = "the order was sent to our office and paid by them later this week without any further delay or note".split()
    texts = []
    for at in range(n):
        said = rng.choice(words, 24).tolist()
        d = "".join(map(str, rng.integers(0, 10, 12)))
        span = (
            f"{rng.choice(words)}.{rng.choice(words)}{d[:2]}@{rng.choice(words)}.example.com", f"10.{int(d[:2])}.{int(d[2:4])}.{d[4]}",
            "4111 1111 1111 1111", f"+1 {d[:3]} {d[3:6]} {d[6:10]}",
        )[at % 4]
        said[12] = span
        texts.append(" ".join(said))
    return texts


def test_tagger_adds_spans_that_the_patterns_miss():
    rows, tags, tagged = pii.labelled_windows(_texts_with_spans(160, 1))
    chosen = [np.array([np.frombuffer(x, np.uint8) for x in part], np.uint8) for part in (rows, tags)]
    assert 0 < sum(tagged) < len(tagged) and all(any(tag) == has for tag, has in zip(tags, tagged, strict=True))
    tagger = pii.fit(*chosen, updates=250)
    hits, tries = collections.Counter(), collections.Counter()
    for at, text in enumerate(_texts_with_spans(200, 2)):
        base = pii.base_spans(text)
        for turn in range(3):
            shown, places, _ = pii.rewritten(text, base, 10**6 + turn)
            if places and not pii.base_spans(shown):
                (start, end, kind), found = places[0], tagger.spans([shown], [[]])[0]
                if pii._plausible(shown[start:end], kind):
                    tries[kind] += 1
                    hits[kind] += places[0] in found
    assert set(tries) >= {"email", "ip", "phone"}
    for kind in ("email", "ip", "phone"):
        assert hits[kind] >= 0.6 * tries[kind], (hits, tries)
    numbers = [f"they sold {pii.harmless(turn)} of them in the end" for turn in range(10**6, 10**6 + 200)]
    base = [pii.base_spans(text) for text in numbers]
    assert sum(map(len, tagger.spans(numbers, base))) <= 10


def test_spans_end_with_their_word_or_number():
    text = "to anna@exämple.com, or (212) 555-0100."
    at = text.index("na@")
    assert pii.widened(text, (at, at + 8, "email")) == (3, text.index(","), "email")
    at = text.index("212")
    assert pii.widened(text, (at, len(text) - 2, "phone")) == (at - 1, len(text) - 1, "phone")
    assert not pii._whole("978-3-16-148410-0", (4, 17, "phone")) and pii._whole("a 212-555-0100.", (2, 14, "phone"))


def test_training_windows_stay_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "fit", lambda ids, tags: seen.append((len(ids), len({x.tobytes() for x in ids}))))
    monkeypatch.setattr(pii, "TRAINING_WINDOWS", 40)
    texts = _texts_with_spans(60, 3)
    docs = spark.createDataFrame([(7, "mail a@b.de or 10.0.0.1")] * 3000 + list(enumerate(texts)), "doc_id long, text string")
    pii.train(docs)
    assert seen[0][0] == 40


def test_marks_stay_in_their_words():
    def reduced(text):
        codes, ends = langid.letters([text, "x"])
        return "".join(map(chr, codes[: ends[0]]))

    assert reduced("हिन्दी है") == " हिन्दी है "
    assert reduced("a \u0301\u0301b 1\ufe0f c\u0301") == " a b c\u0301 "
    assert reduced("\u0301") == reduced("1\ufe0f") == reduced("") == ""


def test_samples_stay_bounded_when_a_row_is_repeated(spark):
    for salt in ("quality", "calibration"):
        rows = spark.range(2000).selectExpr("id % 400 div 100 * 0 as doc_id", "cast(if(id < 1500, 0, id) as string) as text")
        found = batches.smallest(batches.hash_sample(rows, 1.0, salt, ["doc_id", "text"]), 50).collect()
        assert len(found) == 50 == len({row.text for row in found})
    docs = spark.createDataFrame([(1, "one and the same plain sentence about the weather in the town.")] * 500, "doc_id long, text string")
    assert quality.score_documents(docs, training_documents=20).count() == 500
