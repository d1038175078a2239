import itertools
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from compare import connect, difference

from quantloom.llm import entry, merkle
from quantloom.llm.conversations import repair
from quantloom.llm.packing import PLAIN, TokenIds, best_fit, complete, dominated, lower_bound, pack, pieces_of, token_ids
from quantloom.runtime import ship, table

# packing


@pytest.fixture(scope="module")
def encoder():
    return token_ids("byte_bpe_50k.json")


def test_ids_are_those_of_whole_texts(encoder):
    odd = ["", " ", "a<|endoftext|> b", "<|endoftext|>", "  x  <|endoftext|>  y\n\n z", "café 你好 hello  world\x85 \x1c x's it's 12ab3", "'s'll ", " a  b   \t\n c ", "Ǆ×÷½ \xa0\xa0x", "\U0001f600 foo bar", "١٢ ab", "x" * 5000, "one two " * 200_000, "é" * 70 + " naïve 'twas don't DON'T"]
    for text in odd:
        assert encoder(text) == np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:50]
    assert PLAIN.fullmatch("café") and not PLAIN.fullmatch("你")


def test_other_tokenizers_get_whole_texts():
    other = TokenIds("word_bpe_49k.json")
    assert other("Hello  World again") == np.asarray(other.tokenizer.encode("Hello  World again", add_special_tokens=False).ids, "<u4").tobytes()


def fewest(sizes, room):
    """Least number of bins, by trying every place of every piece."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] >= sizes[i]:
                place(i + 1, [*bins[:k], bins[k] - sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, room - sizes[i]])

    place(0, [])
    return best


def bins_of(packed, counts):
    room, left = len(counts) - 1, Counter({s: c for s, c in enumerate(counts) if c})
    for n, filling in packed:
        assert n > 0 and sum(s * k for s, k in filling) <= room
        for s, k in filling:
            left[s] -= n * k
    assert not any(left.values())
    return sum(n for n, _ in packed)


def test_bin_completion_is_optimal_on_small_cases():
    r, gained = random.Random(3), 0
    for _ in range(120):
        room = r.choice([10, 20, 50])
        sizes = sorted((r.randint(1, room) if r.random() < 0.5 else r.randint(room // 4, room // 2 + 1) for _ in range(r.randint(0, 10))), reverse=True)
        counts = [sizes.count(s) for s in range(room + 1)]
        packed, bound = complete(counts)
        n, want = bins_of(packed, counts), fewest(sizes, room)
        assert bound <= want == n <= bins_of(best_fit(counts, room), counts)
        gained += n < bins_of(best_fit(counts, room), counts)
    assert gained


def test_bin_completion_of_many_like_pieces():
    """Counts of a large corpus take no more steps than small ones, and the bound holds."""
    r = random.Random(5)
    counts = [0] + [r.randrange(10**9) for _ in range(64)]
    packed, bound = complete(counts)
    n = bins_of(packed, counts)
    assert bound == lower_bound(np.array(counts, dtype=object)) <= n <= min(bound * 1.01, bins_of(best_fit(counts, 64), counts)) and len(packed) < 2000
    assert bins_of(complete([0] * 65)[0], [0] * 65) == 0
    # best fit takes 12 bins for 15 x 6, 15 x 5, 15 x 4 ... : pieces that fill bins of 15 exactly only across sizes
    counts = [0] * 31
    for s, c in ((16, 20), (8, 20), (6, 20), (15, 20), (10, 20), (5, 20)):
        counts[s] = c
    assert bins_of(complete(counts)[0], counts) == 40


def test_dominance():
    assert dominated(((3, 1), (2, 1)), 0, 1 << 5)  # one piece of 5 in place of 3 + 2
    assert dominated(((3, 1),), 1, 1 << 4) and not dominated(((3, 1),), 0, 1 << 4 | 1 << 3)
    assert dominated(((3, 1),), 2, 1 << 2) and not dominated(((3, 1), (2, 1)), 0, 1 << 6)


def check_packing(rows, texts, encoder, most=1024):
    """Pieces hold each document whole, and sequences are gapless."""
    want = Counter()
    for doc, text in texts:
        ids = np.frombuffer(encoder(text or ""), "<u4").tolist() + [2]
        for k, (start, length) in enumerate(pieces_of(len(ids), most)):
            want[doc, k, start, length, crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
            assert 0 < length <= most and (k == 0 or length == most)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        held.sort()
        assert held[0][0] == 0 and sum(n for _, n in held) <= most
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(held))
    counts = [0] * (most + 1)
    for r in rows:
        counts[r.length] += 1
    assert lower_bound(np.array(counts, dtype=object)) <= len(sequences) <= sum(n for n, _ in best_fit(counts, most))


def test_packing(spark, sf, edge, empty, encoder):
    for docs in (edge, table(spark, sf, "documents"), edge.union(edge).withColumn("doc_id", edge["doc_id"] % 3), edge.selectExpr("CAST(NULL AS long) AS doc_id", "text")):
        check_packing(pack(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], encoder)
    check_packing(pack(edge, max_tokens=7).collect(), [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], encoder, 7)
    assert pack(empty).collect() == []
    (row,) = pack(spark.createDataFrame([(1, "two words")], "doc_id long, text string"), with_ids=True).collect()
    assert row.ids == np.frombuffer(encoder("two words"), "<u4").tolist() + [2]


# conversations


def brute_repair(rows):
    """rows after damage: (turn, role, text) in order. Every edit string up to the cheapest cost."""
    seen, faults = set(), []
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append(1 if not kept else 2 if (role, text) in seen else 3 if kept[-1] not in ".!?" else 0)
        seen.add((role, text))
    best = None

    def go(t, made, cost, audit, lines, inserted):
        nonlocal best
        roles = "".join(made)
        if not re.fullmatch(r"s?(ua)*u?", roles) or best and cost > best[0]:
            return
        if t == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(t, [*made, role[0]], cost + 2, audit + "I", [*lines, role + ":"], inserted + 1)
        if t < len(rows):
            _, role, text = rows[t]
            go(t + 1, made, cost + 3, audit + "D", lines, 0)
            if faults[t] not in (1, 2):
                extra = faults[t] == 3
                go(t + 1, [*made, role[:1]], cost + extra, audit + "K", [*lines, f"{role}:{text}"], 0) if role[:1] in ("s", "u", "a") else None
                for new in ("user", "assistant"):
                    go(t + 1, [*made, new[0]], cost + extra + 2, audit + "R", [*lines, f"{new}:{text}"], 0)

    go(0, [], 0, "", [], 0)
    turns = sorted({t for t, _, _ in rows if t is not None})
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, best[0], best[1], sha256("\n".join(best[2]).encode()).hexdigest())


def hurt(rows):
    """The damage of the query, from its definition; rows in order of turn, nulls first."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def talks():
    r = random.Random(7)
    rows = []
    for conv in [*range(150), None]:
        for turn in [*range(r.randint(1, 4)), *([None] if r.random() < 0.2 else [])]:
            rows.append((conv, None if turn is None else turn * r.choice([1, 1, 3]) if turn == 3 else turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(["Yes.", "No!", "Why?", "cut", "cut  ", "", " \n", None, "Yes.\t", "x" * 3000 + "."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def summary(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def grouped(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return out


def test_repair_by_brute_force(spark, talks):
    ship(spark)
    df = spark.createDataFrame(talks, SCHEMA).selectExpr("*", "1 AS conv", "'x' AS seg", "2 AS pos", "'k' AS kind", "0 AS digest").repartition(5)
    got = {r.conv_id: summary(r) for r in repair(df, damage=True).collect()}
    assert got == {conv: brute_repair(hurt(rows)) for conv, rows in grouped(talks).items()}
    assert any(not hurt(rows) for rows in grouped(talks).values()) and got.keys() == grouped(talks).keys()


def test_repair_in_segments(spark):
    r = random.Random(9)
    rows = [(conv, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(["Yes.", f"No {t}!", f"cut {t}", ""])) for conv, n in ((1, 200), (2, 31), (3, 8), (None, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, cut = ({x.conv_id: summary(x) for x in repair(df, segment=k).collect()} for k in (4096, 7))
    assert whole == cut and whole[1][5] > 100
    made = {}
    for x in repair(df, segment=7, turns=True).collect():
        made.setdefault(x.conv_id, []).append(x)
    for conv, turns in made.items():
        turns.sort(key=lambda x: x.place)
        assert sha256("\n".join(f"{x.role}:{x.text}" for x in turns).encode()).hexdigest() == whole[conv][7]
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in turns))
        assert [x.edit for x in turns] == [e for e in whole[conv][6] if e != "D"]


def test_repair_keeps_legal_and_empty(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "U."), (1, 2, "assistant", "A."), (2, 5, "user", " ")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.conv_id: x for x in repair(df).collect()}
    assert got[1].audit == "KKK" and got[1].cost == 0 and summary(got[2]) == (0, 1, 0, 0, 0, 3, "D", sha256(b"").hexdigest())
    assert repair(df.where("false")).collect() == []


# manifest


def brute_tree(leaves):
    """Root and the siblings of each leaf, from the definition."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 8 * 8 : a // 8 * 8 + 8]
            proofs[i] += run[: a % 8] + run[a % 8 + 1 :]
            at[i] = a // 8
        nodes = [sha256("".join(nodes[i : i + 8]).encode()).hexdigest() for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def brute_leaf(row):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> Counter of the query's rows."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made, out = [], Counter()
    for name in names:
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        made.append((own, *brute_tree([brute_leaf(r) for r in own])))
    root, upper = brute_tree([m[1] for m in made])
    for (own, subroot, proofs), above in zip(made, upper):
        for row, proof in zip(own, proofs):
            text = row[4]
            if row[0] is not None and text is not None and crc32(str(row[0]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            good = brute_leaf((*row[:4], text)) == brute_leaf(row)
            out[row[0], brute_leaf(row), subroot, root, sha256("".join(proof + above).encode()).hexdigest(), good] += 1
    return out


def audits(df):
    rows = merkle.audited(df).collect()
    for r in rows:
        assert r.verified == (r.folded_root == r.root)
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in rows)


def fields(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 520])
def test_traversal(n):
    leaves = [sha256(str(i).encode()).hexdigest() for i in range(n)]
    height = merkle.height_of(n)
    root, proofs = brute_tree(leaves)
    assert merkle.block_root(leaves, height) == root
    for leaf, proof, path in zip(leaves, proofs, merkle.paths(leaves, height), strict=True):
        siblings, shape = merkle.told(path)
        assert siblings.hex() == "".join(proof) and merkle.folded(leaf, siblings, shape) == root
        assert merkle.folded(leaves[0], siblings, shape) == root or leaf != leaves[0]


def test_treehash_memory_is_logarithmic():
    tree = merkle.Treehash(6)
    for i in range(8**4):
        tree.feed(sha256(str(i).encode()).hexdigest())
        assert max(map(len, tree.tails)) <= 7 and not tree.nodes


def test_manifest_edge(spark, edge, empty):
    for df in (edge, edge.where("doc_id = 1"), edge.union(edge), edge.withColumn("doc_id", edge["doc_id"] % 4), edge.selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars")):
        assert audits(df) == brute_manifest(fields(df))
    assert audits(empty) == Counter()


def test_manifest_of_more_than_a_block(spark):
    ship(spark)
    df = spark.range(9000).selectExpr("id * 7 % 9001 AS doc_id", "concat('Text ', id) AS text", "CASE WHEN id % 1000 = 3 THEN NULL WHEN id % 500 = 1 THEN concat('l', id % 17) ELSE 'big' END AS lang", "'s' AS source", "id AS n_chars").repartition(4)
    assert audits(df) == brute_manifest(fields(df))


@pytest.mark.parametrize("name", ["op12_repair_conversations", "op13_merkle_manifest"])
def test_agrees_with_sql(spark, sf, name):
    ship(spark)
    assert not difference(spark, connect(sf), entry.queries()[name], entry.oracle_sql()[name], sf)
