"""Near-dedup, substring dedup and decontamination against the SQL and brute force, on hard cases and at sf0.001."""

import duckdb
import numpy as np
import pytest
from compare import connect, rows_of
from pyspark.sql import functions as F

from quantloom.llm import sql
from quantloom.llm.decontaminate import contained_items, decontaminate
from quantloom.llm.near_dedup import chance, jaccard_estimate, near_duplicates, registers
from quantloom.llm.substring_dedup import substring_dedup
from quantloom.llm.words import mix
from quantloom.runtime import table


def from_sql(query: str, **tables) -> list[tuple]:
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    cur = con.execute(query)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def same(df, want):
    assert rows_of(df.columns, df.collect()) == want


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_edge(edge, k):
    same(near_duplicates(edge, shingle_words=k), from_sql(sql.near_dedup(k), documents=edge))


def test_near_dedup_chain_reaches_over_links(spark):
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(12):  # neighbours are similar, the ends are not
        rows.append((100 - i, " ".join(words)))
        words[i * 4 : i * 4 + 3] = [f"n{i}{j}" for j in range(3)]
    docs = spark.createDataFrame(rows + [(500, "w0 w1 w2"), (500, "w0 w1 w2")], "doc_id long, text string")
    got = near_duplicates(docs, shingle_words=2)
    assert {r.component_id for r in got.where("doc_id <= 100").collect()} == {89}
    assert [(r.n_shingles, r.component_id, r.kept) for r in got.where("doc_id = 500").collect()] == [(2, 500, True)] * 2


def test_near_dedup_many_edited_copies(spark):
    """A large group of near copies of one text, where copies differ more from each other than from it."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for j in rng.choice(300, 25, replace=False):
            w[j] = f"x{rng.integers(1 << 30)}"
        rows.append((i + 10, " ".join(w)))
    docs = spark.createDataFrame(rows + [(5, " ".join(base))], "doc_id long, text string")
    got = near_duplicates(docs, shingle_words=2).collect()
    want = from_sql(sql.near_dedup(2), documents=docs)
    assert rows_of(["doc_id", "n_shingles", "component_id", "kept"], [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got]) == want


def test_sketch_estimate_is_close():
    rng = np.random.default_rng(1)
    for shared in (0, 500, 900, 1000):
        a = mix(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
        b = np.r_[a[:shared], mix(rng.integers(0, 1 << 62, 1000 - shared).astype(np.uint64))]
        regs = registers(np.sort(np.r_[a >> np.uint64(11), (b >> np.uint64(11)) | np.uint64(1 << 53)]), 2)
        n = np.array([1000])
        got = jaccard_estimate(regs[:1], regs[1:], n, n)[0]
        assert abs(got - shared / (2000 - shared)) < 0.12
    assert 0 < chance(np.array([1000.0]), np.array([1000.0]))[0] < 0.01


@pytest.mark.parametrize("size", [50, 10])
def test_substring_edge(edge, size):
    same(substring_dedup(edge, min_words=size), from_sql(sql.substring_dedup(size), documents=edge))


def brute_substring(rows, size):
    """(id, words left) of each row: windows are compared one by one, rows of equal rank never with each other."""
    words = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            if i is not None and (key not in first or i < first[key]):
                first[key] = i
    out = []
    for i, w in words:
        gone = {p for a in range(len(w) - size + 1) if i is not None and first[tuple(w[a : a + size])] < i for p in range(a, a + size)}
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=repr)


def test_substring_rows_of_one_id_and_partial_overlaps(spark):
    """Repeated ids with equal and different texts, null ids, ids that are text, and overlaps longer than half a window but not a whole one."""
    from fixtures import prose

    p = prose(70, 80).split(" ")
    rows = [(5, prose(71, 30) + " " + " ".join(p)), (5, " ".join(p[20:]) + " " + prose(72, 10)), (5, " ".join(p[20:]) + " " + prose(72, 10)), (3, " ".join(p[:60])), (None, " ".join(p)), (None, " ".join(p)), (5, None), (5, "")]
    for n in (13, 24, 25, 26, 37, 49, 50, 51):  # parts of one passage, in front of, behind and between other words
        rows += [(100 + n, prose(n, 9) + " " + " ".join(p[:n])), (200 + n, " ".join(p[-n:]) + " " + prose(90 + n, 9)), (300 + n, prose(190 + n, 60) + " " + " ".join(p[10 : 10 + n]) + " " + prose(290 + n, 60))]
    for kind, cast in (("long", lambda i: i), ("string", lambda i: None if i is None else f"{i:05d}")):
        made = [(cast(i), t) for i, t in rows]
        out = substring_dedup(spark.createDataFrame(made, f"doc_id {kind}, text string"), with_text=True)
        assert sorted(((r.doc_id, " ".join((r.text or "").split())) for r in out.collect()), key=repr) == brute_substring(made, 50)


def test_substring_keeps_text_and_columns(edge):
    out = substring_dedup(edge, with_text=True, carry=("first", "id", "text_a"))
    assert {(r["first"], r["id"], r["text_a"]) for r in out.collect()} == {(1, "clash", "clash")}
    before = {r.doc_id: r.text for r in edge.collect()}
    for r in out.collect():
        if r.n_removed == 0:
            assert r.text == before[r.doc_id]


def items(spark):
    from fixtures import prose

    return spark.createDataFrame([(1, prose(2, 20)), (2, prose(2, 60)), (3, None), (4, ""), (5, "two words"), (6, prose(30, 3000)), (7, prose(99, 30)), (8, prose(2, 20))], "item_id long, text string")


def test_contained_items_edge(spark, edge):
    it = items(spark)
    want = from_sql(sql.contained_items(), documents=edge, benchmark=it)
    assert want
    same(contained_items(edge, it).drop("estimate"), want)
    same(contained_items(edge, it, block_items=2).drop("estimate"), want)
    hit = {r.doc_id for r in contained_items(edge, it).collect()}
    kept = decontaminate(edge, it)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in edge.collect() if r.doc_id not in hit)


def test_items_of_few_words(spark):
    """Found inside longer documents, where their words stand one after another."""
    it = spark.createDataFrame([(1, "Lorem"), (2, "quick  BROWN"), (3, "a b c d"), (4, "a b c d e"), (5, "b c"), (6, "b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x lorem y"), (2, "the quick brown fox"), (3, "quick and brown"), (4, "z a b c d e"), (5, "loremipsum quickbrown"), (6, "lorem"), (7, None), (8, "quick\nbrown quick brown")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.containment) for r in contained_items(docs, it).collect())
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (4, 3, 1.0), (4, 4, 1.0), (4, 5, 1.0), (4, 6, 1.0), (6, 1, 1.0), (8, 2, 1.0)]
    same(contained_items(docs, it).drop("estimate"), from_sql(sql.contained_items(), documents=docs, benchmark=it))
    assert sorted(r.doc_id for r in decontaminate(docs, it).collect()) == [3, 5, 7]


def test_items_without_ids_and_repeated_rows(spark):
    from fixtures import prose

    leak = prose(2, 20)
    it = spark.createDataFrame([(None, leak), (None, leak), (4, prose(3, 20)), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + leak), (1, "x " + leak), (None, leak + " y"), (2, prose(9, 50))], "doc_id long, text string").withColumns({"item": F.lit(1), "id": F.lit("clash")})
    got = sorted(((r.doc_id, r.item_id) for r in contained_items(docs, it, block_items=2).collect()), key=repr)
    assert got == sorted([(1, None)] * 4 + [(None, None)] * 2, key=repr)
    assert [(r.doc_id, r.id) for r in decontaminate(docs, it).collect()] == [(2, "clash")]
    assert decontaminate(docs, it, block_bytes=10).count() == 1


def test_empty_tables(spark, empty, edge):
    assert near_duplicates(empty).collect() == substring_dedup(empty).collect() == []
    none = items(spark).where("false")
    assert contained_items(empty, items(spark)).collect() == contained_items(edge, none).collect() == []
    assert decontaminate(edge, none).count() == edge.count()


def test_given_tables(spark, sf):
    con = connect(sf)
    for df, query in ((near_duplicates(table(spark, sf, "documents"), 5), sql.near_dedup(5)), (substring_dedup(table(spark, sf, "documents")), sql.substring_dedup()), (contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("estimate"), sql.contained_items())):
        cur = con.execute(query)
        same(df, rows_of([d[0] for d in cur.description], cur.fetchall()))
