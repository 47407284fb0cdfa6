"""Each operator against brute force on small tables, and on empty ones."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .data import SCHEMA, documents

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(tokens):
    return zlib.crc32(np.array(tokens, dtype="<u4").tobytes())


def test_token_files(spark, docs, rows, empty, tmp_path):
    from palimpsest.llm import token_files as op

    got = [tuple(r) for r in op.token_files(docs, BYTES, 2).orderBy("start").collect()]
    at, want = 0, []
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1] or "")):
        own = ids(BYTES, text, 2)
        want.append((doc, at, len(own), crc(own)))
        at += len(own)
    assert got == want
    assert op.token_files(empty, BYTES, 2).count() == 0
    path = f"file://{tmp_path}/delta"
    op.write_tokens(docs, path, BYTES, 2, ids="delta", page_rows=10)
    some = op.read_tokens(spark, path, 30, 60).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in some] == sorted(r[0] for r in rows if 30 <= r[0] <= 60)
    assert all(list(r["tokens"]) == ids(BYTES, dict((x[0], x[1]) for x in rows)[r["doc_id"]], 2) for r in some)
    assert "tokens" not in op.read_metadata(spark, path).columns


@pytest.mark.parametrize("text", ["  a  b\n c\t d \n\n e ", "don't 'tis I'll", " ", "\n", "a\x1cb \x1c c", "Σας ΟΔΟΣ x ́y", "漢字 🙂🙂 x1y2 3.14", "<|endoftext|> a<|startoftext|>", "a <|endoftext|> b", "x<|endoftext|>\n<|startoftext|>y, <|endoftext|>", "<|ENDOFTEXT|> <|end oftext|>", "a\r\n b", "A.\nB c,\nd"])
def test_encoder_is_the_library(text):
    from palimpsest.llm.encoding import Encoder

    for path, lower, end in ((BYTES, False, 2), (WORDS, True, 1)):
        assert np.frombuffer(Encoder(path, lower, end)(text), dtype="<u4").tolist() == ids(path, text, end)


def test_encoder_keeps_words_before_what_is_made_of_them():
    from palimpsest.llm.encoding import Encoder

    own = Encoder(BYTES, False, 2)
    texts = ["x qzword, qzother.\nqznext qzword, ünd,", "x qzword,"]
    got = [np.frombuffer(own(t), dtype="<u4").tolist() for t in texts]
    assert got == [ids(BYTES, t, 2) for t in texts]
    assert "qzword" in own.rest and "qzother" in own.rest and "qzword," in own.rest  # the last came again
    assert "qzother.\nqznext" not in own.rest and "ünd," not in own.rest
    lower = Encoder(WORDS, True, 1)
    for text in ("QZWORD Qzword, QZ,qz", "QZ", "a_ B_ _"):
        assert np.frombuffer(lower(text), dtype="<u4").tolist() == ids(WORDS, text, 1)


def test_a_worker_forgets_what_other_operators_remember():
    import pyarrow as pa

    from palimpsest.llm import encoding, shingles, toxicity

    encoding.encoder(BYTES, False, 2)
    again = encoding.encoder(BYTES, False, 2)
    assert encoding.encoder(BYTES, False, 2) is again
    assert [len(shingles.shingle_sets(pa.array(["a b c d e f"]), 5)[0]), len(encoding._encoders)] == [2, 0]
    [_ for _ in toxicity._features([{"doc_id": [1], "grade": [0], "text": ["some words"]}])]
    assert toxicity._by_word and len(shingles._powers[0]) == 1
    assert len(shingles.shingle_sets(pa.array(["a b c d e f"]), 5)[0]) == 2 and not toxicity._by_word


def test_what_a_worker_forgets_is_gone_at_once(monkeypatch):
    import gc
    import pickle
    import weakref

    from palimpsest.llm import encoding, remembered, toxicity

    monkeypatch.setattr(encoding, "KEPT_LOWER", 2)
    own = encoding.encoder(WORDS, True, 1)
    assert np.frombuffer(own("aa bb cc dd"), dtype="<u4").tolist() == ids(WORDS, "aa bb cc dd", 1) and len(own.rest) == 2
    gone = weakref.ref(own)
    del own
    gc.disable()
    try:
        [_ for _ in toxicity._features([])]
        assert gone() is None
    finally:
        gc.enable()
    # Scoring remembers of a word what the model knows of it: for most words nothing.
    toxicity._forget()
    known = toxicity._hashed("horrid")
    model = toxicity.Model(np.array(sorted(known)), np.array([1.0, 2.0, 4.0, 8.0]), np.array([1.0]))
    assert model.latent("A horrid day, horrid!") == 15 and model.latent(None) == 0
    assert not toxicity._by_word and {w: len(x) for w, x in toxicity._told[model.bucket.tobytes()].items()} == {"a": 0, "day": 0, "horrid": 4}
    assert not pickle.loads(pickle.dumps(model)).__dict__.keys() - {"bucket", "weight", "cuts"}
    # A task that ends gives back what it has freed.
    given = []
    monkeypatch.setattr(remembered, "give_back", lambda: given.append(len(out)))
    out = []
    out.extend(remembered.giving_back(lambda batches: (b + 1 for b in batches))([1, 2]))
    assert out == [2, 3] and len(given) == 1


def test_keys_are_counted_in_place():
    import tracemalloc

    from palimpsest.llm.jaccard import repeats

    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (2, 1), (1000, 300), (1000, 10**9)):
        keys = rng.integers(0, top, n).astype(np.uint64)
        want, times = np.unique(keys, return_counts=True)
        found, often = repeats(keys.copy())
        assert found.tolist() == want[times > 1].tolist() and often.tolist() == times[times > 1].tolist()
    keys = rng.integers(0, 1 << 62, 1_000_000).astype(np.uint64)
    tracemalloc.start()
    repeats(keys)
    assert tracemalloc.get_traced_memory()[1] < keys.nbytes
    tracemalloc.stop()


def shingles(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(spark, docs, rows, empty):
    from palimpsest.llm.jaccard import near_duplicates, one_of_each

    sets = {r[0]: shingles(r[1]) for r in rows}
    top = {d: d for d in sets}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    linked = 0
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                linked += 1
                x, y = sorted((find(a), find(b)))
                top[y] = x
    assert linked > 20
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == find(r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if find(r[0]) == r[0])
    assert near_duplicates(empty).count() == 0 and one_of_each(empty).count() == 0


def test_jaccard_random_sets_lose_no_link():
    from palimpsest.llm import jaccard as op

    rng = np.random.default_rng(3)
    none = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = a.copy()
        b[rng.choice(len(a), max(1, len(a) // 12), replace=False)] = rng.integers(0, 1 << 63, max(1, len(a) // 12), dtype=np.uint64)
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 20)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        often = np.sort(rng.choice(np.concatenate([op.emitted(a, *none), [1]]), 3)), np.arange(3)
        for frequent in (none, often):
            common = len(np.intersect1d(op.emitted(a, *frequent), op.emitted(b, *frequent)))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert np.array_equal(a, b) or common >= min(op.differing(len(a)), op.differing(len(b))) + 1 - (len(a) + len(b)) * 20 // 180
        x, y = op.dense(a).view(np.uint64), op.dense(b).view(np.uint64)
        while len(x) != len(y):  # the longer one folds, as parities add up
            x, y = (x, y) if len(x) > len(y) else (y, x)
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a) + len(b) - 2 * both


@pytest.mark.parametrize("bits", [64, 7])
def test_jaccard_large_groups(spark, monkeypatch, bits):
    """Near copies of one text, in chains and families, unlike texts around a long common passage, rows without doc_id: blocks of three sets meet, and with 7 bits many sets have one h1."""
    from palimpsest.llm import jaccard as op

    monkeypatch.setattr(op, "MEET", 3)
    monkeypatch.setattr(op, "FEW", 4)
    if bits < 64:
        whole = op._sets

        def narrow(batch, words):
            for ids, hashes, bounds, n, h1, h2 in whole(batch, words):
                yield ids, hashes, bounds, n, h1 & np.uint64((1 << bits) - 1), h2

        monkeypatch.setattr(op, "_sets", narrow)
    rng = np.random.default_rng(12)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    base, passage, texts = some(120), some(70), []
    for i in range(90):
        own = list(base)
        for at in rng.integers(0, 120, i % 15):
            own[at] = f"x{i}y{at}"
        texts.append(" ".join(own))
    family = base[:80] + some(40)
    for i in range(20):
        own = list(family)
        own[5 * i] = f"z{i}"
        texts.append(" ".join(own))
    texts += [" ".join([*some(15 + i % 9), *passage, *some(6)]) for i in range(60)]
    rows = [(None if i % 13 == 5 else i, t) for i, t in enumerate(texts)]
    sets = [shingles(t) for t in texts]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    got = {r["doc_id"]: r["component_id"] for r in op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r["doc_id"] is not None}
    assert len(set(got.values())) < len(got) - 25
    assert got == {d: least[find(i)] for i, (d, _) in enumerate(rows) if d is not None}


MASK = (1 << 64) - 1


def xx64(data, seed):
    """XXH64 of the library, as signed."""
    import xxhash

    h = xxhash.xxh64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def plain_sketch(text, scale):
    """The fingerprint by plain Python: words' hashes, hashes of runs of five of them, all below the threshold."""
    from palimpsest.llm.common import SPACE

    words = [w for w in text.lower().translate({ord(c): " " for c in SPACE}).split(" ") if w]
    own = [xx64(w.encode(), 42) for w in words]

    def run(hashes):
        seed = 42
        for h in hashes:
            seed = xx64((h & MASK).to_bytes(8, "little"), seed & MASK)
        return (seed & MASK) >> 1

    found = {run(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else ({run(own)} if own else set())
    return sorted(h for h in found if h < (1 << 63) // scale)


def test_fingerprints(spark, docs, rows, empty):
    from palimpsest.llm.fingerprints import SCALE, compare_with_edits

    more = [(None, "without an id, " + "abc def " * 9, None, "s", 1, 1, None, None, 1, "k"), (None, None, None, None, None, None, None, None, None, None)]
    got = compare_with_edits(docs.unionByName(spark.createDataFrame(more, SCHEMA))).collect()
    assert len(got) == len(rows) + 2 and sum(r["doc_id"] is None for r in got) == 2
    plain = {r[0]: r[1] or "" for r in rows}
    order, like = sorted(plain), lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    prints = {d: set(plain_sketch(t, SCALE)) for d, t in plain.items()}
    for r in got:
        if r["doc_id"] is None:
            continue
        text = plain[r["doc_id"]]
        half = len(text) // 2
        repeated = sum(x[0] == r["doc_id"] for x in rows) > 1
        last = r["doc_id"] == order[-1]
        after = order[(order.index(r["doc_id"]) + 1) % len(order)]
        options = {plain[after]: prints[after]} | ({text: prints[r["doc_id"]]} if repeated else {})
        if last:  # what has no id comes first
            options = {t: set(plain_sketch(t, SCALE)) for t in (more[0][1], "")}
        assert r["n_chars"] == len(text)
        edits = {hashlib.sha256((e := text[: len(text) - half] + o[:half]).encode()).hexdigest(): (e, p) for o, p in options.items()}
        edited, follower = edits[r["edited_sha256"]]
        own, edited = prints[r["doc_id"]], set(plain_sketch(edited, SCALE))
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple("".join(f"{h:016x}" for h in sorted(p)) for p in (own, edited))
        assert r["near_edited"] == pytest.approx(like(own, edited))
        assert any(r["near_next"] == pytest.approx(like(own, p)) for p in ([follower] if len(edits) == len(options) else options.values()))
    assert compare_with_edits(empty).count() == 0


def test_fingerprint_estimates(spark):
    """Estimated likeness and containment come near the true ones on long texts, also for unequal lengths."""
    from palimpsest.llm.fingerprints import containment, likeness, merged, sketch

    w = [f"w{i}" for i in range(12000)]
    df = spark.createDataFrame([(" ".join(w), " ".join(w[:2000]), " ".join(w[6000:]))], "a string, b string, c string")
    a, b, c = (sketch(F.col(x)) for x in "abc")
    row = df.select(containment(b, a).alias("inside"), containment(a, b).alias("part"), likeness(a, c).alias("half"), likeness(a, merged(a, c)).alias("same")).first()
    assert row["inside"] == 1 and abs(row["part"] - 2000 / 12000) < 0.04 and abs(row["half"] - 0.5) < 0.05 and row["same"] > 0.99


def test_packing(docs, rows, empty):
    from palimpsest.llm.packing import pack

    for size in (64, 4096):
        got = pack(docs, WORDS, 1, size=size).collect()
        want = Counter()
        for doc, text, *_ in rows:
            own = ids(WORDS, text, 1)
            for piece, at in enumerate(range(0, len(own), size)):
                want[doc, piece, at, len(own[at : at + size]), crc(own[at : at + size])] += 1
        assert Counter(tuple(r)[:5] for r in got) == want
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= size
        total = sum(r["length"] for r in got)
        assert len(sequences) <= -(-total // size) + 1
    assert pack(empty, WORDS, 1).count() == 0


def test_fullest_is_exact():
    from itertools import product

    from palimpsest.llm.packing import fullest

    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = np.zeros(31, dtype=np.int64)
        counts[rng.integers(3, 31, 4)] = rng.integers(1, 4, 4)
        room = int(rng.integers(0, 31))
        used = np.flatnonzero(counts)
        best = max(s for c in product(*(range(int(counts[u]) + 1) for u in used)) if (s := int(np.dot(c, used))) <= room)
        found = fullest(room, counts)
        assert sum(found) == best and all(found.count(x) <= counts[x] for x in found)


def test_sharding(docs, rows, empty):
    from palimpsest.llm.sharding import difference, shard

    got = shard(docs, 7).collect()
    assert len(got) == len(rows)
    of_text, slots = defaultdict(set), defaultdict(list)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        of_text[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    of_group, of_shard = Counter(), Counter()
    for r in got:
        of_shard[r["shard"]] += r["size"]
        of_group[r["text_crc32"]] += r["size"]
    # No shard is above an even share by more than the largest group that can't be divided.
    assert max(of_shard.values()) <= sum(of_shard.values()) / 7 + max(of_group.values())
    assert shard(empty, 7).count() == 0
    rng = np.random.default_rng(2)
    sums = np.zeros((400, 8), dtype=np.int64)
    sums[:, 0] = rng.integers(10, 10_000, 400)
    total = np.bincount(difference(sums)[:, 0], weights=sums[:, 0], minlength=8)
    assert total.max() - total.min() < 100


def test_mixing(docs, rows, empty):
    from palimpsest.llm.mixing import mixed_documents, mixed_sizes

    got = sorted(tuple(r) for r in mixed_sizes(docs).collect())
    assert got == sorted(tuple(r) for r in mixed_sizes(docs).collect())
    size = {r[0]: len([w for w in (r[1] or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]) for r in rows}
    source = {r[0]: r[3] for r in rows}
    sums = Counter()
    for r in rows:
        sums[r[3]] += size[r[0]]
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sums.values()), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sums[s]}
        if not over:
            break
        target |= {s: 2.0 * sums[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    target |= {s: level * weight[s] for s in free}
    by_source, largest = Counter(), Counter()
    for doc, n, _, _, taken in got:
        by_source[source[doc]] += taken
        largest[source[doc]] = max(largest[source[doc]], n)
    spread = {s: 4 * sum((n / 2) ** 2 for doc, n, *_ in got if source[doc] == s) ** 0.5 for s in names}  # four standard deviations of the draw
    assert all(abs(by_source[s] - target[s]) <= spread[s] + 1e-6 for s in names)
    for doc, n, of_source, wanted, taken in got:
        assert (n, of_source) == (size[doc], sums[source[doc]])
        assert wanted == pytest.approx(target[source[doc]])
        assert taken <= 2 * n and (n == 0 or taken % n == 0)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    counted = Counter(r["doc_id"] for r in mixed.collect())
    assert sum(size[d] * n for d, n in counted.items()) == sum(r[4] for r in got)
    assert mixed_sizes(empty).count() == 0 and mixed_documents(empty).count() == 0


def test_line_dedup(docs, rows, empty):
    from palimpsest.llm.line_dedup import cleaned_documents, dedup_lines

    sites, first = defaultdict(set), {}
    for doc, text, _, source, *_ in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if line.strip(" "):
                sites[line.strip(" ")].add(source)
                first[line.strip(" ")] = min(doc, first.get(line.strip(" "), doc))
    gone = {x for x, s in sites.items() if len(s) >= 4}
    assert gone
    want = {r[0]: None if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" ") not in gone or first[x.strip(" ")] == r[0]) for r in rows}
    got = dedup_lines(docs, sites=4).collect()
    assert len(got) == len(rows) and all(r["text"] == want[r["doc_id"]] for r in got)
    assert sum(r["n_removed"] for r in got) > 5
    clean = cleaned_documents(docs, sites=4)
    assert clean.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"] or "") for r in clean.collect())
    assert dedup_lines(empty).count() == 0


def test_licences(spark, empty):
    from palimpsest.llm.licenses import KNOWN, scan

    mit = KNOWN[0][1]
    texts = [
        mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,"), "(c) X\n" + mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), mit + " and more",
        "Some prose.\nReleased under the MIT Licence!\nLicensed under  CC BY-NC 4.0", None, "", "Released under the MIT License.",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r["doc_id"]: (r["license"], r["notices"], r["n_notices"]) for r in scan(df).collect()}
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, "MIT"]
    assert got[4][1:] == ("CC-BY-NC-4.0,MIT", 2) and got[7][1:] == ("MIT", 1) and got[5][1:] == ("", 0)
    assert scan(empty).count() == 0


def test_licences_wrapped_anywhere(spark):
    """Known texts keep their digest at every width, and holders' lines of every form are left out."""
    import textwrap

    import duckdb

    from palimpsest.llm.licenses import KNOWN, digest
    from palimpsest.llm.oracles import _normalised

    apache = 'You must retain all copyright, patent and (c) You must keep notices; a copyright license, copyrighted and copyrightable work, copyright and related rights, each copyright\nowner. We copyright the software under copyright law.'
    texts = {name: text for name, text in KNOWN if len(text) > 200} | {"other": apache}
    holders = ["", "Copyright (c) 2020 Someone", "COPYRIGHT 1999-2004, A. Body", "Copyright © The Authors", "Copyright The Go Authors", "(c) X", "© 2001 Y", "Copyright: Z", "  Copyright (C) <year> <name>"]
    rows = [(name, "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))) for name, text in texts.items() for width in range(20, 110)]
    rows += [(name, f"{line}\n\n{text}") for name, text in texts.items() for line in holders]
    got = spark.createDataFrame(rows, "name string, text string").select("name", "text", digest(F.col("text")).alias("digest")).collect()
    odd = {(r["name"], r["text"][:60]) for r in got if r["digest"] != next(x["digest"] for x in got if x["name"] == r["name"] and x["text"] == "\n\n" + texts[r["name"]])}
    assert not odd
    con = duckdb.connect()
    assert all(con.execute(f"SELECT md5({_normalised('?')})", [r["text"]]).fetchone()[0] == r["digest"] for r in got[::7])


def test_licences_entire_texts(spark):
    from pathlib import Path

    from palimpsest.llm.licenses import _ISC_END, _ISC_GRANT, known_digests, scan

    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    holder = "Copyright (c) 2020, Someone\n"
    texts = [("BSD-2-Clause", f"{t}{holder}{r}{bsd % ''}") for t in ("", "BSD 2-Clause License\n\n") for r in ("", "All rights reserved.\n")]
    texts += [("BSD-3-Clause", f"{t}{holder}{r}{bsd % third}") for t in ("", "BSD 3-Clause License\n\n") for r in ("", "All rights reserved.\n")]
    texts += [("ISC", f"ISC License\n\n{holder}\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}")]
    texts += [("0BSD", f"BSD Zero Clause License\n\n{holder}\n{_ISC_GRANT}.\n\n{_ISC_END}")]
    files = {"Apache-2.0": "Apache-2.0", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for name, file in files.items():
        if (path := Path("/usr/share/common-licenses") / file).exists():
            texts.append((name, path.read_text(encoding="latin-1")))
            texts.append((name, texts[-1][1].replace("https://", "http://").replace("\n", "\r\n")))
    got = {r["doc_id"]: r["license"] for r in scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]
    assert known_digests(spark).groupBy("digest").count().where("count > 1").count() == 0


def test_neighbours(spark):
    from palimpsest.llm.neighbours import neighbours

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:340] = x[7]
    rows = [(i, [float(v) for v in v], "e") for i, v in enumerate(x)]
    rows += [(1000, None, ""), (1020, [0.0] * 16, ""), (1040, [float("nan")] * 16, ""), (1060, [None] * 16, ""), (1080, [1.0] * 3, ""), (5, rows[5][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(4)
    got = defaultdict(dict)
    for r in neighbours(df).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 900, 20))
    y, found = x.astype(np.float64), []
    for q, own in got.items():
        score = np.einsum("ij,j->i", y, y[q])
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:20]
        assert sorted(own) == list(range(1, 21)) and q not in {v for v, _ in own.values()}
        assert all(abs(s - score[v]) < 1e-12 for v, s in own.values())
        found.append(len({v for v, _ in own.values()} & set(best.tolist())) / 20)
    assert np.mean(found) >= 0.9
    assert neighbours(df.limit(0)).count() == 0


def test_neighbours_recall_holds_at_many_vectors(spark, tmp_path, monkeypatch):
    """Random vectors, the hardest: what prefix ranges hold is enough, a small part of all, and many ranges, parts and blocks give what one does."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from palimpsest.llm import neighbours as op

    n, every = 50_000, 500
    x = np.random.default_rng(8).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), tmp_path / "v.parquet")
    found = op.neighbours(spark.read.parquet(str(tmp_path / "v.parquet")), every=every).collect()
    got, looked = defaultdict(set), defaultdict(set)
    for r in found:
        got[r["query_id"]].add(r["vec_id"])
        looked[r["query_id"]].add(r["looked_at"])
    score = x[::every] @ x.T
    score[np.arange(n // every), np.arange(0, n, every)] = -np.inf
    best = np.argpartition(-score, 20, axis=1)[:, :20]
    assert np.mean([len(got[q * every] & set(b.tolist())) / 20 for q, b in enumerate(best)]) >= 0.92
    assert np.mean([sum(s) for s in looked.values()]) < 0.1 * n


def test_neighbours_in_pieces(spark, monkeypatch):
    """Ranges, parts, blocks and shards are where the work is done; results don't depend on them."""
    from palimpsest.llm import neighbours as op

    x = np.random.default_rng(3).normal(size=(3000, 12)) + 2 * (np.arange(3000) % 3 == 0)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    whole = sorted(tuple(r)[:4] for r in op.neighbours(df).collect())
    for name, value in (("RANGE", 150), ("BLOCK", 17), ("SHARD", 400), ("ASKING", 11), ("TOGETHER", 900)):
        monkeypatch.setattr(op, name, value)
    assert sorted(tuple(r)[:4] for r in op.neighbours(df).collect()) == whole


def test_neighbours_of_near_copies(spark):
    """Near copies share long prefixes in all trees; the search goes on past them to all that a query is due, and finds what lies beyond."""
    from palimpsest.llm.neighbours import neighbours

    rng = np.random.default_rng(9)
    x = rng.normal(size=(8000, 64))
    for i in range(0, 400, 20):  # 12 each, from alike to hardly different
        x[i + 1 : i + 13] = x[i] + rng.normal(size=(12, 64)) * (i + 1) / 4000
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in neighbours(df).collect():
        got[r["query_id"]].append(r["vec_id"])
    assert {q: len(set(own)) for q, own in got.items()} == dict.fromkeys(range(0, 8000, 20), 20)
    score = x @ x[:400:20].T
    score[np.arange(0, 400, 20), np.arange(20)] = -np.inf
    best = np.argsort(-score, axis=0)[:20].T
    assert np.mean([len({*got[20 * q]} & {*b.tolist()}) / 20 for q, b in enumerate(best)]) >= 0.9


@pytest.mark.parametrize("again", [1, 40])
def test_neighbours_scored(again):
    """Repeated pairs of query and entry, two vectors with one hash and a query at the root: scores of each pair once, by brute force."""
    import pandas as pd

    from palimpsest.llm import neighbours as op

    rng = np.random.default_rng(2)
    x, h1 = rng.normal(size=(60, 8)), np.sort(rng.integers(-(2**62), 2**62, 60))
    h1[11] = h1[10]
    entries = pd.DataFrame({"h1": h1, "ids": [[100 + i] for i in range(60)], "embedding": list(x)}).sample(frac=1, random_state=1)
    asks = {100: [3, 10, 50, 7], 120: list(range(60)), 140: [0, 59]}  # 120 is at the root
    query = np.repeat([100, 100, 100, 100, 140, 140], again)
    entry = np.tile(h1[[3, 10, 50, 7, 0, 59]], (again, 1)).T.ravel()
    mixed = rng.permutation(len(query))
    rows = [{"query_id": q, "embedding": x[q - 100], "root": q == 120, "queries": None, "entries": None} for q in (140, 100, 120)]
    rows.append({"query_id": 0, "embedding": None, "root": False, "queries": query[mixed].astype("<i8").tobytes(), "entries": entry[mixed].astype("<i8").tobytes()})
    got = op._scored(5)(entries, pd.DataFrame(rows))
    asks[100].append(11)
    for q, own in asks.items():
        want = sorted((-float(np.einsum("ij,j->i", x[[e]], x[q - 100])[0]), 100 + e) for e in own if 100 + e != q)[:5]
        mine = got[got["query_id"] == q]
        assert list(mine["vec_id"]) == [v for _, v in want] and np.allclose(mine["score"], [-s for s, _ in want], rtol=0, atol=1e-12) and set(mine["seen"]) == {len(own)}


def test_toxicity(spark, docs, rows, empty):
    from palimpsest.llm import toxicity as op

    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    texts, marks = [], []
    for i in range(900):
        own = list(rng.choice(plain, int(rng.integers(5, 200))))
        toxic = i % 5 == 0
        if toxic:
            own[int(rng.integers(0, len(own)))] = ("moron", "idiot", "loweichen", "loweiung")[i // 10 % 4]
        texts.append(" ".join(own))
        marks.append(int(toxic))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m, None if i % 50 == 49 else 1) for i, m in enumerate(marks) if i % 2], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in op.toxic_scores(df, labels).collect()}
    held = [i for i in range(900) if i % 2 == 0]  # not labelled
    right = sum(got[i]["toxic"] == bool(marks[i]) for i in held)
    assert right / len(held) > 0.98
    assert all(0 <= r["severity"] <= 2 for r in got.values())
    kept = op.clean_documents(docs, labels.select((F.col("doc_id") * 3).alias("doc_id"), "toxic"))
    assert kept.columns == docs.columns
    assert op.toxic_scores(empty, labels).count() == 0
    assert op.toxic_scores(df, labels.limit(0)).where("toxic").count() == 0


def test_severity_orders_texts(spark):
    """Labels say toxic or not; the texts with more abuse get the higher grades and severity, whatever their length."""
    from palimpsest.llm import toxicity as op

    rng = np.random.default_rng(9)
    plain = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    abuse = ["moron", "idiot", "loweichen", "wretch", "scumbag", "dimwit"]
    texts, much = [], []
    for i in range(1500):
        own = list(rng.choice(plain, int(rng.integers(20, 200))))
        n = int(rng.integers(1, 6)) if i % 3 == 0 else 0
        own += list(rng.choice(abuse, n, replace=False))
        rng.shuffle(own)
        texts.append(" ".join(own))
        much.append(n)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(m > 0)) for i, m in enumerate(much) if i % 2], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in op.toxic_scores(df, labels).collect()}
    held = [i for i in range(1500) if i % 2 == 0]
    mean = [np.mean([got[i]["severity"] for i in held if much[i] == n]) for n in range(6)]
    assert mean[0] < 0.2 and all(a < b for a, b in zip(mean[1:], mean[2:], strict=False)) and mean[5] > 1.5
    long = [i for i in held if much[i] and len(texts[i]) > 800]
    short = [i for i in held if much[i] and len(texts[i]) <= 800]
    assert abs(np.mean([got[i]["severity"] - mean[much[i]] for i in long]) - np.mean([got[i]["severity"] - mean[much[i]] for i in short])) < 0.15
    assert {got[i]["grade"] for i in held if much[i] >= 4} == {2} and {got[i]["grade"] for i in held if not much[i]} == {0}


def test_cumulative_links_share_weights():
    import pandas as pd

    from palimpsest.llm.toxicity import fit

    rows = pd.DataFrame([(i, i % 3, [1] * (i % 3 > 0) + [2] * (i % 3 > 1) + [3]) for i in range(300)], columns=["doc_id", "grade", "features"])
    model = fit(rows)
    assert np.all(np.diff(model.cuts) > 0)
    weight = dict(zip(model.bucket.tolist(), model.weight.tolist(), strict=True))
    expected = [model.above(np.array([sum(weight.get(b, 0) for b in own)])).sum() for own in ([3], [1, 3], [1, 2, 3])]
    assert expected[0] < 0.5 < expected[1] < 1.5 < expected[2]


def test_rows_without_ids_and_long_texts(spark):
    """Every operator takes rows without doc_id, null and empty texts, one text of 20,000 words, and columns that clash with its own."""
    from palimpsest.llm import fingerprints, jaccard, licenses, line_dedup, mixing, packing, sharding, token_files, toxicity

    rng = np.random.default_rng(2)
    long = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(20_000))
    rows = [(None, "a text without an id of its own", "s"), (None, "a text without an id of its own", None), (None, None, None), (1, long, "s"), (2, long + " end", "t"), (3, "", "t"), (None, "other", "u"), (4, "a text without an id of its own", "u")]
    df = spark.createDataFrame([(*r, 0, "x", 1, 2) for r in rows], "doc_id long, text string, source string, n_chars long, target string, start long, rank int").repartition(3)
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert token_files.token_files(df, BYTES, 2).count() == len(rows)
    assert fingerprints.compare_with_edits(df).count() == len(rows)
    packed = packing.pack(df, WORDS, 1).collect()
    assert sum(r["length"] for r in packed) == sum(len(ids(WORDS, t, 1)) for _, t, _ in rows)
    found = jaccard.near_duplicates(df).collect()
    assert len(found) == len(rows) and {r["component_id"] for r in found if r["doc_id"] in (1, 2)} == {1}
    assert sorted(r["component_id"] for r in found if r["doc_id"] is None and r["component_id"] is not None) == [4, 4]
    assert jaccard.one_of_each(df).count() == len(rows) - 1
    shards = sharding.shard(df, 3).collect()
    assert len(shards) == len(rows) and len({r["shard"] for r in shards if r["size"] == 31 + 16}) == 1
    assert licenses.scan(df).count() == len(rows) and line_dedup.dedup_lines(df).count() == len(rows)
    assert mixing.mixed_sizes(df).count() == len(rows) and mixing.mixed_documents(df).columns == df.columns
    assert toxicity.toxic_scores(df, labels).count() == len(rows) and toxicity.clean_documents(df, labels).columns == df.columns
    with pytest.raises(ValueError):
        mixing.mix(df)
