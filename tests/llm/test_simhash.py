import itertools
import random

import xxhash

from notespark.llm.simhash import BITS, covering_masks, fingerprint, fingerprint_links, simhash_components


def _plain(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in pieces]
    return sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows, radius):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
            parent[root(i)] = root(j)
    out = []
    for i, (doc, fp) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if root(j) == root(i) and d is not None]
        out.append((doc, fp, min(ids, default=None)))
    return out


def _unsigned(x):
    return x % (1 << BITS)


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 2):
        masks = [_unsigned(m) for m in covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(BITS), radius):
            differing = sum(1 << b for b in bits)
            assert any(not m & differing for m in masks)


def test_fingerprint_is_the_plain_one():
    texts = ["", " ", "One", "one two", "a b c d e", "É é A\x85b c d", "x " * 500, "\t\x0b\x0c\r\n"]
    for text in texts:
        for k in (1, 3, 5):
            assert _unsigned(fingerprint(text.encode(), k)) == _plain(text, k)


def test_links_reach_what_all_pairs_reach(spark):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(40)}
    for x in list(values)[:20]:  # chains and stars of near values
        for _ in range(6):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(x)
    centre = rng.getrandbits(64)
    values |= {centre ^ 1 << i for i in range(64)}
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()
    assert all(1 <= (_unsigned(r.u) ^ _unsigned(r.v)).bit_count() <= 2 for r in links)
    found = {frozenset(x) for x in _groups(values, [(_unsigned(r.u), _unsigned(r.v)) for r in links])}
    pairs = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2]
    assert found == {frozenset(x) for x in _groups(values, pairs)}


def _groups(values, pairs):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = {}
    for v in values:
        groups.setdefault(root(v), []).append(v)
    return groups.values()


def test_awkward_rows(spark):
    words = [f"w{i}" for i in range(400)]
    near = [*words]
    near[7] = "other"
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, "a b c", "x"), (None, "a b c", "x"),
        (4, "A B C", "x"), (5, " ".join(words), "x"), (6, " ".join(near), "x"), (6, " ".join(near), "x"),
        (7, "only null", "x"), (None, "alone with no id", "x"), (8, "y " * 30000, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, _unsigned(r.fp), r.component_id) for r in simhash_components(docs).collect()), key=str)
    want = _components([(d, _plain(t, 3)) for d, t, _ in rows], 2)
    assert got == sorted(want, key=str)
    assert simhash_components(docs.limit(0)).count() == 0
