import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelake.llm import manifest, packing, whitening, wordpieces

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
ODD = [
    None, "", "  ", "it's 'sure !'s l'homme 's's '' 're 'rex 'LL 1'd ''d can't'", "a\x1cb <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
    "Ünïcode É É 1234 a1b2 ½ ٣٤ ΑΣ ΣΑΣ x y İ ẞ", "́abc ́ x'́s", "3×4÷2 naïve, ÀÉ! ŉ ſ", "x" * 3000, "\x7f\x00a 日本語 text", "a" * 70 + " b\tc\nd",
]


def test_ids_equal_the_library():
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("abcXYZ'é×İß 1239.,!<|>\t\n\x1c ́ '’日") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    theirs = tokenizers.Tokenizer.from_file(PATH)
    want = [theirs.encode(t or "", add_special_tokens=False).ids for t in texts]
    for limit, remembered in ((1 << 20, 1_000_000), (40, 200)):
        encode = wordpieces.Encoder(PATH, limit, remembered)
        assert encode.by_pieces
        assert [ids.tolist() for ids in encode.texts(pa.array(texts))] == want


def test_another_vocabulary_goes_to_the_library_whole():
    encode = wordpieces.Encoder(P.path("byte_bpe_50k.json"))
    theirs = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert not encode.by_pieces
    assert [i.tolist() for i in encode.texts(pa.array(ODD))] == [theirs.encode(t or "", add_special_tokens=False).ids for t in ODD]


def plain_best_fit(lengths, capacity):
    rooms, count = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def fewest(lengths, capacity):
    """Least sequences by trying all ways."""

    def fits(rest, rooms):
        if not rest:
            return True
        return any(fits(rest[1:], rooms[:i] + [room - rest[0]] + rooms[i + 1 :]) for i, room in enumerate(rooms) if room >= rest[0] and room not in rooms[:i])

    rest = sorted(lengths, reverse=True)
    return next(k for k in itertools.count() if fits(rest, [capacity] * k))


def test_best_fit_decreasing_and_its_bound():
    r = random.Random(6)
    for _ in range(150):
        lengths = [r.randint(1, 12) for _ in range(r.randint(0, 9))]
        at, offset, made = packing.best_fit_decreasing(np.array(lengths, np.int64), 12)
        assert sorted(12 - sum(n for n, a in zip(lengths, at) if a == k) for k in range(made)) == plain_best_fit(lengths, 12)
        for k in range(made):
            mine = sorted((o, n) for n, a, o in zip(lengths, at, offset) if a == k)
            assert [o for o, _ in mine] == [0, *itertools.accumulate(n for _, n in mine)][:-1]
        least = packing.bound(np.bincount(np.array(lengths, np.int64), minlength=13), 12)
        assert least <= fewest(lengths, 12) <= made
    # pieces of just over half a sequence cannot share one, which their tokens alone do not tell
    assert packing.bound(np.bincount([7] * 10, minlength=13), 12) == 10


def check_packing(rows, got, capacity):
    theirs = tokenizers.Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(d), k, s, ids[s : s + capacity]) for k, s in enumerate(range(0, len(ids), capacity))]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((d, k, s, len(ids), crc(ids)) for d, k, s, ids in want) == sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(parts[-1]) <= capacity
    return len(by_sequence), packing.bound(np.bincount([len(i) for *_, i in want], minlength=capacity + 1), capacity)


def test_packing_of_every_row_nears_the_bound(spark, sf):
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, "twice"), (3, "twice")]
    rows += [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 100, "text").collect()]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, True) for d, t in rows], "doc_id long, text string, row long, bucket string, length long, settled boolean")
    shape = packing.Shape(capacity=256, per_partition=60)
    made, least = check_packing(rows, packing.pack(docs, PATH, shape).collect(), 256)
    alone, _ = check_packing(rows, packing.pack(docs, PATH, shape._replace(rounds=1)).collect(), 256)
    assert least <= made <= least * 1.005 and made < alone  # partitions of 60 pieces, of which few fit together
    made, least = check_packing(rows, packing.pack(docs, PATH).collect(), 4096)
    assert made == least


def test_packing_of_nothing_and_whole_sequences(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six"), (3, None)], "doc_id long, text string")
    packed = packing.pack(docs, PATH, packing.Shape(capacity=4), with_ids=True)
    theirs = tokenizers.Tokenizer.from_file(PATH)
    found = [r.ids for r in packing.sequences(packed).collect()]
    assert sorted(sum(found, [])) == sorted(sum((theirs.encode(t, add_special_tokens=False).ids + [1] for t in ("one two three four five", "six", "")), []))
    assert len(found) == 3 and max(map(len, found)) == 4


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and the siblings of each node on its way up as (is left, digest)."""
    way = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owners = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for k in range(len(run)):
                for o in owners[i + k]:
                    way[o].append((k == 1, run[1 - k]) if len(run) == 2 else None)
            up.append(h(*run))
            up_owners.append(sum(owners[i : i + 2], []))
        nodes, owners = up, up_owners
    return nodes[0], way


def plain_manifest(rows):
    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
    root, above = plain_tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        for row, way in zip(groups[g], trees[g][1]):
            d, source, lang, n, text = row
            bad = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
            at = leaf((d, source, lang, n + bad if n is not None else None, text))
            for step in way + up:
                at = h(at) if step is None else h(step[1], at) if step[0] else h(at, step[1])
            proof = h(*(s[1] for s in way + up if s))
            out.append((str(d), leaf(row), trees[g][0], root, proof, at, at == root))
    return sorted(out)


def manifest_of(spark, rows, levels):
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at long, grp string, node string, block long")
    bad = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("doc_id").isNotNull()
    found = manifest.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "lang", {"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, levels=levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((str(r.doc_id), *r[1:]) for r in found.collect())


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_a_plain_tree(spark, levels):
    rows = [(i, None if i % 5 == 0 else f"s{i % 3}", ["en", "en", "de", None, "fr"][i % 5] if i != 77 else "ö", None if i % 11 == 0 else i, ["", "é" * i, None, "x"][i % 4]) for i in range(83)]
    rows += [(7, "s1", "de", 7, "x"), (7, "s1", "de", 7, "x"), (7, "s1", "de", 8, "x"), (None, None, None, None, None), (None, "a", "en", 3, "")]
    got = manifest_of(spark, rows, levels)
    # equal rows of a key may stand in either order
    assert got == plain_manifest(rows)
    assert sum(not r[-1] for r in got) > 5


def test_manifest_of_nothing_one_leaf_and_one_group(spark):
    assert manifest_of(spark, [], 2) == []
    for rows in ([(1, "a", "en", 1, "t")], [(i, "a", "en", 1, "t") for i in range(9)], [(None, None, None, None, None)]):
        assert manifest_of(spark, rows, 2) == plain_manifest(rows)


def test_versions_copy_only_ancestors():
    tree = manifest.Tree([h(str(i)) for i in range(11)], 4)
    before = [list(level) for level in tree.levels]
    copied = tree.copied(6, h("other"))
    assert len(copied) == 5 and copied[-1] == plain_tree([h("other") if i == 6 else h(str(i)) for i in range(11)])[0]
    assert tree.levels == before and tree.copied(6, h("6"))[-1] == tree.root


def test_polar_and_eigenvectors():
    r = np.random.default_rng(1)
    spectra = [r.uniform(0, 1, 40), np.r_[np.ones(10), np.zeros(10)], np.r_[np.full(7, 3.0), 3 + 1e-9, 1, 1e-8], [2.0], [1.0, 1.0, 1.0], 10.0 ** -np.arange(12), [0.0, 0.0, 0.0], [5.0, 5.0, 2.0, 1e-15]]
    for values in spectra:
        n = len(values)
        q, _ = np.linalg.qr(r.normal(size=(n, n)))
        v = (q * values) @ q.T
        v = (v + v.T) / 2
        e, x = whitening.eigenvectors(v)
        size = max(np.abs(v).max(), 1e-300)
        assert np.abs(x.T @ x - np.eye(n)).max() < 1e-13
        assert np.abs(v @ x - x * e).max() < 1e-13 * size * n or size < 1e-200
        assert np.abs(e - np.sort(values)[::-1]).max() <= 1e-13 * n * max(max(values), 1e-300) and (np.diff(e) <= 0).all()
    a = r.normal(size=(9, 9))
    a = a + a.T
    e, x = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - (x * np.sign(e)) @ x.T).max() < 1e-12


def plain_whitening(rows, k):
    usable = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in usable]
    fit = np.array(sorted({tuple(v) for _, v in x}), np.int64)
    n, sums = len(fit), fit.sum(0)
    d = fit - sums / n
    v = d.T @ d / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return [(i, [int(a) for a in v], n, sum((n * a - int(s)) ** 2 for a, s in zip(v, sums)), (np.array(v) - sums / n) @ q / np.sqrt(e)) for i, v in x], e / np.trace(v)


def test_whitening_equals_a_plain_one(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [(-1, None), (-2, []), (-3, [float("nan")] * 64), (-4, [1.0] * 63 + [None]), (-5, [1.0] * 63 + [float("inf")]), (rows[0][0], rows[0][1]), (-6, rows[1][1]), (-7, [0.5] * 63), (None, rows[2][1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, component int, x int")
    got = whitening.whiten(frame).toPandas()
    want, explained = plain_whitening([(i, v) for i, v in rows if i != -7], 16)
    assert len(got) == 16 * len(want) and set(got["n"]) == {want[0][2]}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    signs, by_id = {}, {i: (d, w) for i, _, _, d, w in want}
    for i, mine in got.groupby("vec_id"):
        mine = mine.sort_values("component", kind="stable").drop_duplicates("component")
        d, w = by_id[i]
        assert set(mine["deviation"]) == {d}
        np.testing.assert_allclose(mine["explained"], explained, rtol=1e-9)
        for c, a, b in zip(mine["component"], mine["whitened"], w):
            sign = signs.setdefault(c, np.sign(a * b))
            assert abs(a - sign * b) < 1e-6
    assert whitening.whiten(frame.filter("false")).count() == 0
    assert whitening.whiten(frame.filter("vec_id = -6")).count() == 0  # no variance


def test_deviation_is_exact_up_to_a_long(spark):
    rows = [(i, [c, 1.0]) for i, c in enumerate((1e300, -1e300, 0.25, 0.5))]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [int(max(min(64 * c, 2.0**40), -(2.0**40)) // 1) for _, (c, _) in rows]
    want = [sum((4 * a - sum(x)) ** 2 for a in [v]) for v in x]
    assert got == {i: v if v < 1 << 63 else None for i, v in enumerate(want)} and None in got.values() and got[2] is not None
