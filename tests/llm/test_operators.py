"""Training-data operators on a small table of awkward rows, against brute force where SQL has no form."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from assetdeck.llm import (bpe, exact_dedup, licenses, packing, pii, quality_classifier, quality_rules, queries, simhash, suffixes,
                           toxicity)

LONG = " ".join(f"w{i * i % 977} q{i}" for i in range(4000))
PASSAGE = " ".join(f"passage{i} text{i * 7}" for i in range(60))
#: Nulls in every column, empty and very long texts, ties, repeated rows; the other columns clash with internal names.
ROWS = [
    (1, "Alpha beta gamma. " * 30, "en", "a"), (2, "Alpha beta gamma. " * 30, "en", "b"), (3, None, None, None), (4, "", "en", "a"),
    (None, "no id here at all", "en", "a"), (5, LONG, "en", "a"), (6, LONG.replace("q77 ", "q77x "), "en", "a"), (7, "x" * 3000, "de", "b"),
    (8, f"before one {PASSAGE} after one", "en", "a"), (9, f"other lead {PASSAGE} and tail", "fr", "b"), (9, f"other lead {PASSAGE} and tail", "fr", "b"),
    (10, "mail Bob.X@mail.example.com or +49 (30) 1234-5678, ip 10.0.0.255 and 999.1.1.1, card 4111 1111 1111 1111, 12345", "en", "a"),
    (11, "日本語 ünï 🤦🏼‍♂️  tabs\t\tand\r\nlines\n\nü" * 20, "ja", "c"), (12, " \n\t ", "en", "a"), (13, "don't we'll <|endoftext|>  %%%", "en", None),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, sig string, key long, fp string, row string, size int"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, g, s, len(t) if t else None, None, "s", 1, "f", "r", 2) for i, t, g, s in ROWS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


TEXTS = [(i, t or "") for i, t, _, _ in ROWS]


def reference_ids(text):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference_ids.enc = getattr(reference_ids, "enc", None) or tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return reference_ids.enc.encode_ordinary(text)


def key(row):
    return tuple((x is None, x) for x in row)


def test_exact_dedup(docs):
    got = sorted((tuple(r) for r in exact_dedup.label(docs).collect()), key=key)
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[t].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in TEXTS), key=key)
    assert got == want
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted(groups)


def test_digest_index_admits_only_unknown_texts(spark, docs):
    index = exact_dedup.DigestIndex.fresh(spark, buckets=3)
    index.add(exact_dedup.digests(docs.where("doc_id < 8")))
    first = {bytes(r.digest): r.keep_id for r in index.rows().collect()}
    index.add(exact_dedup.digests(docs))
    again = {bytes(r.digest): r.keep_id for r in index.rows().collect()}
    assert len(again) == index.rows().count() == len({t for _, t in TEXTS})
    assert all(again[d] == k for d, k in first.items())


def test_digest_index_outlives_its_table_and_session(spark, docs):
    index = exact_dedup.DigestIndex.fresh(spark, buckets=3)
    index.add(exact_dedup.digests(docs))
    want = sorted(bytes(r.digest) for r in index.rows().collect())
    other = spark.newSession()
    again = exact_dedup.DigestIndex(other, "another_name_of_the_index", index.path, buckets=5)
    assert again.buckets == 3 and sorted(bytes(r.digest) for r in again.rows().collect()) == want
    assert again.add(exact_dedup.digests(other.createDataFrame([(77, "not seen before"), (78, "x" * 3000)], "doc_id long, text string"))).count() == 1
    again.drop_table()
    index.drop_table()
    third = exact_dedup.DigestIndex(spark, "third_name", index.path, buckets=3)
    assert third.rows().count() == len(want) + 1
    third.drop_table()


def test_known_texts_stay_with_their_earlier_document(spark):
    index = exact_dedup.DigestIndex.fresh(spark, buckets=2)
    kind = "doc_id long, text string"
    exact_dedup.label(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], kind), index).collect()
    later = spark.createDataFrame([(9, "a"), (8, "a"), (7, "c"), (7, "c")], kind)
    got = sorted(tuple(r)[:4] for r in exact_dedup.label(later, index).collect())
    assert got == [(7, 7, 2, True), (7, 7, 2, True), (8, 2, 2, False), (9, 2, 2, False)]
    assert exact_dedup.deduplicate(later, index).count() == 0


def test_quality_rules(docs):
    for r in quality_rules.verdicts(docs).collect():
        assert not (r.base_failed and r.kept)
    got = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and got[7].n_words == 1 and got[5].kept and got[8].kept
    words = re.findall(r"[^\x20\x09-\x0D]+", dict(TEXTS)[1])
    windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    assert got[1].n_repeat_words == len(covered) and got[1].base_failed
    clean = quality_rules.clean(docs)
    assert clean.columns == docs.columns and {5, 6, 8, 9} <= {r.doc_id for r in clean.collect()}


def test_frequent_lines_go_and_the_first_document_keeps_them(spark):
    body = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{'x' * k}" for k in range(30))  # noqa: E731  digits are normalised
    rows = [(i, f"Share this page now\n{body(i)}", "h", "en") for i in range(40)]
    rows += [(100 + i, "Share this page now\nshort tail of words " + f"t{i}", "h", "en") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    limits = quality_rules.Limits(min_words=3)
    texts = {r.doc_id: r.text for r in quality_rules.clean(d, limits).collect()}
    assert set(range(40)) <= set(texts) and sum("Share" in t for t in texts.values()) == 1
    assert max(r.n_removed for r in quality_rules.verdicts(d, limits).collect()) == 4


def test_long_lines_are_counted_like_short_ones(spark):
    notice = " ".join(f"notice{k}" for k in range(60))
    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{'x' * k}" for k in range(80))
    rows = [(i, f"{notice.upper()} \t\n{own(i)}", "h", "en") for i in range(40)]
    rows += [(100 + i, f"  {notice.replace(' ', chr(9) + ' ', 3)}\nshort tail t{i}", "h", "en") for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality_rules.verdicts(d).collect()}
    assert sorted(r.n_removed for r in got.values()) == [0] + [60] * 42
    assert all(got[i].kept for i in range(40)) and sum(got[100 + i].kept for i in range(3)) <= 1
    texts = {r.doc_id: r.text for r in quality_rules.clean(d).collect()}
    assert sum("notice" in t.lower() for t in texts.values()) == 1 and set(texts) == {i for i in got if got[i].kept}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    fps = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    todo, root = set(range(len(fps))), {}
    while todo:
        part, front = set(), [todo.pop()]
        while front:
            p = front.pop()
            part.add(p)
            near = {q for q in todo if bin(fps[p][1] ^ fps[q][1]).count("1") <= 2}
            todo -= near
            front += near
        least = min((fps[p][0] for p in part if fps[p][0] is not None), default=None)
        root |= dict.fromkeys(part, least)
    want = sorted(((i, f"{f:016x}", root[k]) for k, (i, f) in enumerate(fps)), key=key)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=key) == want
    left = simhash.deduplicate(docs)
    assert left.columns == docs.columns and left.count() == len(set(root.values()))


def _components(points, links):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in points}


@pytest.mark.parametrize("shard", [40, 500])
def test_no_shard_outgrows_its_bound_and_no_link_is_lost(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = random.Random(shard)
    centre = rng.getrandbits(64)
    ball = {centre} | {centre ^ (1 << a) for a in range(64)} | {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}  # no ball parts it
    points = {rng.getrandbits(64) for _ in range(600)} | ball
    for p in rng.sample(sorted(points), 200):
        points.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in sorted(points)]
    classes = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(4)
    fitting, dense = simhash.shards(classes, 2, sample=128, shard=shard)
    sizes = [r["count"] for r in fitting.groupBy("shard").count().collect()]
    assert max(sizes) <= shard and set(signed) == {r.fp for r in fitting.collect()} | {r.fp for r in dense.collect()}
    got = [(r.a, r.b) for r in simhash.links(classes, 2, sample=128, shard=shard).collect()]
    x = np.array(signed, np.int64).view(np.uint64)
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)
    assert _components(signed, got) == _components(signed, [(signed[a], signed[b]) for a, b in near if a < b])
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in got)


def test_spanning_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (300, 6), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (300, 6), dtype=np.uint64))
    points = np.unique(np.concatenate([base, flips.ravel()]))

    def roots(links):
        r = list(range(len(points)))

        def find(x):
            while r[x] != x:
                x = r[x]
            return x

        for a, b in links:
            x, y = sorted((find(a), find(b)))
            r[y] = x
        return [find(i) for i in range(len(points))]

    every = [(i, int(j)) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 2)]
    links = simhash.spanning_links(points, 2)
    assert roots(links) == roots(every) and len(links) < len(every)
    tree, pairs = simhash.VantageTree(points[::7], 32, 2), set()
    for _, at in tree.route(points):
        pairs |= {(int(at[a]), int(at[b])) for a, b in simhash.spanning_links(points[at], 2)}
    assert tree.shards > 4 and roots(pairs) == roots(every)


def test_bpe_round_trip(docs):
    got = sorted((tuple(r) for r in bpe.round_trip(docs).collect()), key=key)
    want = []
    for i, t in TEXTS:
        ids = reference_ids(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=key)
    tokens = bpe.encode(docs.where("doc_id = 11"))
    row, text = tokens.first(), dict(TEXTS)[11]
    assert row.starts[0] == 0 and row.ends[-1] == len(text) and all(a < b for a, b in zip(row.starts, row.ends))
    assert bpe.decode(tokens).first().text == text


def test_bpe_equals_the_rank_file_on_any_characters():
    rng = random.Random(2)
    signs = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　​'strevmld019½²ⅷäöß日本🤦🏼‍♂️éA%!|̀ñ\x00"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 50))) for _ in range(2000)] + ["a" * 3000, " " * 3000]
    codec = bpe.Codec.here(bpe.VOCABULARY)
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == reference_ids(t) and codec.decode(ids).decode() == t


def test_packing_places_every_piece_once(docs):
    rows = packing.pack(packing.pieces(docs), per_partition=4, fan_in=2).collect()
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(bpe.VOCABULARY), collections.Counter()
    for i, t in TEXTS:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_ids_are_those_of_the_library_by_default():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(bpe.VOCABULARY), bpe.Codec.here(bpe.VOCABULARY)
    ids = lambda of, t: np.frombuffer(of([t])[0], "<i4").tolist()
    odd = ["a<|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\nx", "<|endoftext|", "ü <|endoftext|>ü"]
    for t in [t for _, t in TEXTS] + odd:
        assert ids(codec.encode_with_added, t) == library.encode(t, add_special_tokens=False).ids
    library.encode_special_tokens = True
    for t in odd:  # elsewhere the literal is ordinary text
        assert ids(codec.encode, t) == library.encode(t, add_special_tokens=False).ids and 50256 not in ids(codec.encode, t)


def test_pieces_forgotten_and_asked_again(monkeypatch):
    want = bpe.Codec(bpe.VOCABULARY).encode([t for _, t in TEXTS])
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    assert bpe.Codec(bpe.VOCABULARY).encode([t for _, t in TEXTS]) == want


def test_lower_bound_is_a_bound_and_best_fit_fills_well():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 1025, 400)
        fill = packing.best_fit_decreasing(lengths, 1024)[2]
        bound = packing.lower_bound(lengths, 1024)
        assert -(-lengths.sum() // 1024) <= bound <= len(fill) <= 1.1 * bound
    assert packing.lower_bound(np.full(9, 513), 1024) == 9 and packing.lower_bound(np.full(9, 342), 1024) == 5


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(500):
        x = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_repeats(texts, n):
    starts = collections.Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if starts[t[i:i + n]] > 1:
                cover[i:i + n] = b"\1" * n
        left = bytes(c for c, x in zip(t, cover) if not x)
        out.append((len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup(docs, monkeypatch):
    want = sorted(((i, *x) for (i, _), x in zip(TEXTS, brute_repeats([t.encode() for _, t in TEXTS], 400))), key=key)
    got = suffixes.deduplicate(docs)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == want
    monkeypatch.setattr(suffixes, "KEY_LIMIT", 1)  # every key is halved down to single windows
    assert sorted((tuple(r)[:5] for r in suffixes.deduplicate(docs, with_data=False).collect()), key=key) == want


def brute_terms(texts):
    """Per text the words that reveal an entity of it, by the rule of the docstring; distinct texts, patterns as found."""
    import math

    found, words = {}, {}
    for t in set(texts):
        spans = [m.span() for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",) for m in re.finditer(p, t)]
        found[t] = {t[a:b].lower() for a, b in spans}
        bare = list(t)
        for a, b in spans:
            bare[a:b] = " " * (b - a)
        words[t] = {w.lower() for w in re.findall(r"[^\W\d_]{4,}", "".join(bare))}
    n = len(found)
    with_word = collections.Counter(w for t in found for w in {w.lower() for w in re.findall(r"[^\W\d_]{4,}", t)})
    with_entity = collections.Counter(e for es in found.values() for e in es)
    both = collections.Counter((e, w) for t in found for e in found[t] for w in words[t])
    passes = {p for p, k in both.items() if k / (k + 1) * math.log(n * k / (with_entity[p[0]] * with_word[p[1]])) >= 0.5 * math.log(n / with_entity[p[0]])}
    return {t: {w for e in found[t] for w in words[t] if (e, w) in passes} for t in found}


def test_pii(docs):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    r, text = got[10], dict(TEXTS)[10]
    found = [(k, text[int(a):int(b)]) for k, a, b in (s.split(":") for s in r.spans.split(","))]
    base = [("email", "Bob.X@mail.example.com"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234-5678")]
    assert found == base + [("term", "mail"), ("term", "mail"), ("term", "card")]  # words of this text alone
    assert got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[10] == "[TERM] [EMAIL] or [PHONE], ip [IP] and 999.1.1.1, [TERM] [CARD], 12345" and texts[3] is None and texts[4] == ""


def test_revealing_terms_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}word" for a in "abcdefgh" for b in "ijklmnop"]
    texts = []
    for k in range(220):
        words = [rng.choice(vocabulary[: 1 + int(64 * rng.random() ** 2)]) for _ in range(12)]
        texts.append(" ".join(words + [f"p{rng.randrange(25)}@x.org" for _ in range(rng.choice([0, 0, 0, 1, 3]))]))
    texts += [" ".join(f"a{k}@list.org" for k in range(5_000)) + " lonelyword " + vocabulary[0]] * 2  # one class of entities
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = pii._found(d, F.col("doc_id"))
    terms = {bytes(r.sig): set(r.terms) for r in pii.disclosive_terms(d, found).collect()}
    want = brute_terms(texts)
    assert {t: terms.get(hashlib.md5(t.encode()).digest(), set()) for t in want} == want and "lonelyword" in want[texts[-1]]


def test_revealing_terms_go_and_common_ones_stay(spark):
    rows = [(i, f"line{'abcdefgh'[i]} the common words physicist{' ' * i} wrote to ada@example.org about things") for i in range(5)]
    rows += [(10 + i, f"the common words wrote about things number{i}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "physicist" not in texts[0] and "[TERM]" in texts[0] and "common words" in texts[0] and "ada@" not in texts[0]
    assert texts[12] == rows[7][1]


def test_terms_of_whole_documents_reveal_without_a_floor(spark):
    far = " ".join(["the common words"] * 20)
    rows = [(0, f"lovelace {far} ada@example.org"), (1, f"ada@example.org {far} lovelace and hapaxword"), (2, f"bob@example.org {far} unusual")]
    rows += [(10 + i, "the common words wrote about things") for i in range(2)] + [(100 + i, f"common words number{i} things") for i in range(97)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(d).collect()}
    assert [got[i].n_term for i in (0, 1, 2, 10, 100)] == [1, 2, 1, 0, 0]
    texts = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert texts[0] == f"[TERM] {far} [EMAIL]" and texts[1] == f"[EMAIL] {far} [TERM] and [TERM]" and texts[2] == f"[EMAIL] {far} [TERM]"


def test_copying_documents_changes_no_span(spark):
    rows = [(i, f"the common words physicist number {chr(97 + i) * 5} wrote to ada@example.org") for i in range(3)]
    rows += [(10 + i, f"the common words {chr(97 + i % 26)}{chr(97 + i // 26)}xx physicist") for i in range(6)]
    rows += [(100 + i, f"the common words wrote about things number{i}") for i in range(100)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    many = once.unionAll(spark.createDataFrame(rows[:9] * 40, once.schema))
    spans = {r.doc_id: (r.spans, r.n_term) for r in pii.find(once).collect()}
    assert spans[0][1] and {(r.doc_id, (r.spans, r.n_term)) for r in pii.find(many).collect()} == set(spans.items())


def test_licences(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code\n# Licensed under the Apache License, Version 2.0.\n"),
             ("a/b/c/y.py", "nothing here"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
             ("z.py", None), ("a/y.py", ""), ("a/y.py", ""), (None, "x")]
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "MIT", None), "a/b/c/x.py": ("Apache-2.0", "Apache-2.0", None), "a/b/c/y.py": (None, "GPL-3.0", "a/b/COPYING"),
                   "a/b/COPYING": ("GPL-3.0", "GPL-3.0", None), "z.py": (None, None, None), "a/y.py": (None, "MIT", "a/LICENSE")}


def test_licences_of_whole_headers_and_files(spark):
    """Among 400 other files, as rare as in a large corpus: titles and notices that wrap over lines, whole short licences."""
    gpl2 = "\n                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Someone\n Everyone is permitted\n" + "text of it\n" * 300
    notice = ("# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
              "# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n#\n\nimport os\n")
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + "\n".join(dict(licenses.TEMPLATES)["MIT"].split(". "))
    files = [("a/LICENSE", gpl2), ("b/x.py", notice), ("c/COPYING.txt", mit), ("c/d/e.py", "import os"), ("d/x.c", "// " + " ".join(f"word{k}" for k in range(5_000)))]
    files += [(f"z/{k}.txt", f"version {k % 3} of the software, june {k} 1991 free license of some general kind\nother {k}\n" + "public words " * 30) for k in range(400)]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [got[p] for p, _ in files[:5]] == ["GPL-2.0", "GPL-2.0", "MIT", "MIT", None] and {got[p] for p, _ in files[5:]} == {None}


def test_licence_query_on_awkward_documents(spark, docs, tmp_path):
    extra = spark.createDataFrame([(20, "Released under the MIT License.", "en", "a/b/c"), (21, "x", "en", "a/b/c"), (21, "y", "en", "a/b/c")],
                                  "doc_id long, text string, lang string, source string")
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = collections.Counter((r.doc_id, r.license) for r in queries.QUERIES["op4_license_scans"](spark, str(tmp_path)).collect())
    # 20 is the licence file of the directory that holds 21, both rows of it
    assert sum(got.values()) == len(ROWS) + 3 and got[21, "MIT"] == 2 and got[20, "MIT"] == 1 and got[None, None] == 1


@pytest.mark.parametrize("name,label", [("op2_toxicity", "toxic"), ("op9_quality_classifier", "quality")])
def test_held_out_accuracy(spark, name, label):
    d = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    for y in (0, 1):
        mine = [r.predicted == y for r in rows if r[label] == y]
        assert len(mine) > 20 and np.mean(mine) > 0.85


@pytest.mark.parametrize("kind,empty", [(toxicity, 0.0), (quality_classifier, 0.5)])
def test_training_without_labels_with_one_class_and_with_repeated_ids(spark, docs, kind, empty):
    every = F.lit(True)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, y int")
    none = kind.train(docs, labels([]), "y", every)
    assert {r.score for r in kind.score(docs.where("text IS NULL"), none).collect()} == {empty}
    one = kind.train(docs, labels([(1, 0), (2, 0), (5, None), (6, 7), (7, 0), (7, 1)]), "y", every)
    assert all(0 <= r.score < 0.5 for r in kind.score(docs.where("doc_id = 1"), one).collect())
    many = spark.createDataFrame([(1, f"text {k}") for k in range(200)] + [(k, "other") for k in range(2, 30)], "doc_id long, text string")
    sample = toxicity.sample(many, labels([(k, k % 2) for k in range(30)]), "y", every, 5, 50)
    rows = sample.collect()
    assert len(rows) == 10 and sorted(r.y for r in rows) == [0] * 5 + [1] * 5 and len({r.doc_id for r in rows}) == 10


def brute_noisy_or(model, text):
    keep = 1.0
    for a, b in toxicity.sentences(text):
        s = model[""] + sum(model.get(f, 0.0) for w in text[a:b].lower().split() for f in toxicity.features(w) if f)
        keep *= 1 - min(1 / (1 + np.exp(-s)), 1 - 1e-9)
    return 1 - keep


def test_noisy_or_scores_and_gradient():
    texts = ["you scum went out into the rain today. fine words here for all of us now"] * 60 + ["all fine words here for us and the rain today"] * 90
    y = np.array([1] * 60 + [0] * 90)
    model = toxicity.fit(texts, y)
    for t in texts[::50]:
        spans, p = toxicity.Scorer(model).sentence_scores(t)
        assert abs(1 - np.prod(1 - p) - brute_noisy_or(model, t)) < 1e-9

    def loss(m):
        each = [brute_noisy_or(m, t) for t in texts]
        return sum(-np.log(q if k else 1 - q) * (0.5 / 60 if k else 0.5 / 90) for q, k in zip(each, y))

    start = {"": -5.0}
    assert loss(model) < 0.2 * loss(start)


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 8)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    cost = np.full(60, 0.7)
    w = quality_classifier.dual_coordinate_descent([(np.arange(8), r) for r in x], y, 8, cost, epochs=2000)
    primal = 0.5 * w @ w + np.sum(cost * np.maximum(0, 1 - y * (x @ w)))
    # the weights are those of some 0 <= a <= C: the dual value at the best such a closes the gap
    from itertools import repeat

    a = np.zeros(60)
    for _ in repeat(None, 4000):
        for i in range(60):
            a[i] = min(max(a[i] - (y[i] * x[i] @ ((a * y) @ x) - 1) / (x[i] @ x[i]), 0), cost[i])
        if primal - (a.sum() - 0.5 * ((a * y) @ x) @ ((a * y) @ x)) < 1e-3 * primal:
            break
    assert primal - (a.sum() - 0.5 * ((a * y) @ x) @ ((a * y) @ x)) < 2e-3 * primal


def test_classifiers_on_awkward_rows(docs):
    model = toxicity.fit(["you scum. fine words here", "all fine words here"] * 20, np.array([1, 0] * 20))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len({i for i, _ in TEXTS}) and got[3].score == 0 and got[3].worst_start is None
    assert [r.sentence for r in toxicity.offending(docs, model, 0.0).where("doc_id = 4").collect()] == []
    model = quality_classifier.fit(["good clean words", "%%% bad%%% !!!"] * 5, np.array([1, 0] * 5))
    assert quality_classifier.score(docs, model).count() == len(ROWS)


def test_empty_tables(docs):
    none = docs.where("false")
    for f in (exact_dedup.label, exact_dedup.deduplicate, quality_rules.verdicts, quality_rules.clean, simhash.near_duplicates, simhash.deduplicate,
              bpe.round_trip, suffixes.deduplicate, pii.find, pii.sanitise, lambda d: packing.pack(packing.pieces(d)),
              lambda d: licenses.scan(queries.source_files(d)), lambda d: toxicity.score(d, {"": -5.0}), lambda d: toxicity.offending(d, {"": -5.0}),
              lambda d: quality_classifier.score(d, {"": 0.0, "\n": 1.0})):
        assert f(none).count() == 0


def test_pipeline_on_awkward_rows_and_on_none(spark, docs):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through every stage."""
    import corpus_pipeline

    for rows in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, rows, None)
            assert after.columns == rows.columns and after.count() <= rows.count()
            rows = after
        placed = corpus_pipeline.STAGES[-1][1](spark, rows, None)
        assert {r.doc_id for r in placed.collect()} == {r.doc_id for r in rows.collect()}
    kept = corpus_pipeline.rules(spark, docs, None)
    verdicts = {r.doc_id: r.kept for r in quality_rules.verdicts(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdicts.items() if k}


def test_very_long_texts(spark):
    text = " ".join(f"word{k % 97} mail{k}@x.org" if k % 1_000 == 0 else f"word{k % 97}" for k in range(30_000))
    d = spark.createDataFrame([(1, text + ". Released under the MIT License."), (2, "x" * 300_000), (3, "short text. of two")], "doc_id long, text string")
    assert toxicity.score(d, {"": -5.0}).count() == 3
    assert {r.score for r in quality_classifier.score(d, {"": 0.0, "\n": 1.0}).collect()} == {0.5}
    spans = {r.doc_id: r for r in pii.find(d).collect()}
    assert spans[1].n_email == 30 and spans[2].spans == "" and spans[3].n_term == 0
    files = d.select(F.concat(F.lit("a/"), "doc_id").alias("path"), "text")
    assert {r.path: r.license for r in licenses.scan(files).collect()} == {"a/1": None, "a/2": None, "a/3": None}


def test_pipeline_keeps_one_of_each_group(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, d).cache()
        assert after.columns == docs.columns
        if name == "exact_dedup":
            assert sorted(r.text for r in after.collect()) == sorted({r.text for r in docs.collect()})
        if name == "simhash_near_dedup":
            want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)
        if name == "pii":
            assert after.count() == docs.count() and not after.where(r"text rlike '[a-z]@mail[0-9]\\.example'").count()
        docs = after
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in placed} == {r.doc_id for r in docs.collect()}
