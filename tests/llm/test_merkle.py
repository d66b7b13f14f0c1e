import zlib
from hashlib import sha256

from kbforge.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def folded(levels, k, digest):
    """The root from a replaced node, and the siblings' digests."""
    proof = []
    for level in levels[:-1]:
        run = level[k // 16 * 16 : k // 16 * 16 + 16]
        slot = k % 16
        proof += run[:slot] + run[slot + 1 :]
        digest, k = h(*run[:slot], digest, *run[slot + 1 :]), k // 16
    return digest, proof


def brute(rows):
    """``rows``: doc_id, source, lang, n_chars, text."""
    groups = {}
    for row in rows:
        bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        low = row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
        groups.setdefault(row[1], []).append((row[0], leaf(row, row[4]), leaf(row, low if bad else row[4])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = climbed([r[1] for r in groups[name]])
    top = climbed([trees[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        for k, (doc_id, own, other) in enumerate(groups[name]):
            subroot, below = folded(trees[name], k, other)
            root, above = folded(top, at, subroot)
            out.append((doc_id, own, trees[name][-1][0], top[-1][0], h(*below, *above), root, root == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string"


def check(spark, rows, parts=5):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return got


def test_trees_of_all_sizes_against_brute_force(spark):
    rows = [(i, f"s{n}", "en", i, f"Text {i} ÄÖ") for n in (1, 2, 15, 16, 17, 256, 257) for i in range(n)]
    rows += [(10_000 + i, "large", None, None, None if i % 7 == 0 else f"UPPER {i}") for i in range(2 * 4096 + 17)]
    got = check(spark, rows)
    assert {r[6] for r in got} == {True, False}


def test_odd_rows_against_brute_force(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "a", "x", 1, "A"), (5, "a", "", 0, ""), (5, "a", "", 0, ""), (5, "a", "", 0, "B" * 200_000)]
    rows += [(-3, "", "-", 2, "-"), (7, "é", "en", 1, "1:-"), (8, "z", "en", 1, "x"), (9, "𝔸", "en", 3, "\0Z"), (1 << 62, "a", "en", 1, "Z")]
    check(spark, rows)
    check(spark, rows[:1])


def test_many_groups_against_brute_force(spark):
    check(spark, [(i, f"g{i % 4500}", "en", 1, "T") for i in range(4600)])


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_fold_hashes_nothing_on_the_left():
    digests = [h(str(i)).encode() for i in range(300)]
    block = merkle.Block(digests, merkle.levels_of(300))
    for k in (0, 15, 16, 299):
        other = [*digests[:k], b"0" * 64, *digests[k + 1 :]]
        assert block.folded(k, b"0" * 64) == merkle.Block(other, 3).root
        assert block.folded(k, digests[k]) == block.root
    state = block.states[0][0][3].copy()
    state.update(b"".join(digests[3:16]))
    assert state.hexdigest() == merkle._parent(digests[:16])[0].decode()
