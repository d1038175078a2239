"""DuckDB SQL for the results that SQL can express over whole tables."""

from __future__ import annotations

SPACED = r"[^\x20\x09-\x0D]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingle_sets(name: str, table: str, key: str, k: int) -> str:
    """CTEs name_w (words) and name (distinct k-word shingles of each row)."""
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all({LOWERED}, '{SPACED}') AS w FROM {table}),
{name} AS MATERIALIZED (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(len(w) - {k - 1}), lambda i: array_to_string(w[i + 1:i + {k}], ' ')) END) AS sh FROM {name}_w)"""


def near_dedup(k: int = 2, percent: int = 80) -> str:
    """Pairs by prefix filtering (the rarest shingles of each set), confirmed on full sets; components by closure."""
    return f"""WITH RECURSIVE {_shingle_sets("s", "documents", "doc_id", k)},
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
df AS (SELECT sh, count(*) AS c FROM s GROUP BY ALL),
ranked AS (SELECT s.doc_id, s.sh, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df.c, s.sh) AS k FROM s JOIN df USING (sh) JOIN n USING (doc_id)),
prefix AS MATERIALIZED (SELECT doc_id, sh, n FROM ranked WHERE k <= n - ((n * {percent} + 99) // 100) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.sh = b.sh AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)),
links AS (SELECT c.a, c.b FROM cand c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.sh = x.sh GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= {percent} * (c.na + c.nb - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY ALL)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(r.root, d.doc_id), d.doc_id) AS component_id, coalesce(r.root >= d.doc_id, true) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN roots r USING (doc_id)"""


def contained_items(k: int = 5, percent: int = 80) -> str:
    """Items of fewer than k words are runs of their own length, looked for only if there are such items."""
    run = "list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' '))"
    return f"""WITH {_shingle_sets("d", "documents", "doc_id", k)}, {_shingle_sets("i", "benchmark", "item_id", k)},
few AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS sh FROM i_w WHERE len(w) BETWEEN 1 AND {k - 1}),
runs AS (SELECT DISTINCT doc_id, n, unnest({run}) AS sh FROM d_w, (SELECT DISTINCT n FROM few) WHERE len(w) >= n),
long AS (SELECT item_id, sh FROM i WHERE item_id NOT IN (SELECT item_id FROM few)), n AS (SELECT item_id, count(*) AS n FROM long GROUP BY ALL)
SELECT d.doc_id, l.item_id, count(*) / n.n AS containment FROM d JOIN long l USING (sh) JOIN n USING (item_id)
GROUP BY d.doc_id, l.item_id, n.n HAVING 100 * count(*) >= {percent} * n.n
UNION ALL SELECT runs.doc_id, few.item_id, 1.0::DOUBLE FROM runs JOIN few USING (n, sh)"""


def substring_dedup(size: int = 50) -> str:
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
h AS MATERIALIZED (SELECT doc_id, unnest(range(len(w) - {size - 1})) AS pos, unnest(list_transform(range(len(w) - {size - 1}), lambda i: md5(array_to_string(w[i + 1:i + {size}], ' ')))) AS h FROM w),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY ALL),
gone AS (SELECT DISTINCT h.doc_id, h.pos + unnest(range({size})) AS i FROM h JOIN f USING (h) WHERE f.least < h.doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word.word, ' ' ORDER BY word.i) AS text FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY ALL)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, len(w.w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def warc() -> str:
    return """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM d"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII string, bit by bit."""
    codes = f"list_concat([4294967295::BIGINT], list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"


def merkle(every: int = 3, levels: int = 7, upper: int = 3) -> str:
    """Trees of up to 8**levels leaves, 8**upper of them: each level groups the nodes, and a document's path takes the other nodes of its run."""

    def leaf(text: str) -> str:
        fields = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    lowered = f"(CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % {every} = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END)"
    steps = [f"""d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf, {leaf(lowered)} AS claimed FROM documents),
p0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof, claimed AS fold FROM d),
t0 AS (SELECT tree, i, leaf AS h FROM p0)"""]
    for k in range(levels + upper):
        if k == levels:
            steps.append(f"""top AS MATERIALIZED (SELECT tree AS own, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM t{k}),
q{k} AS MATERIALIZED (SELECT p.* REPLACE ('' AS tree, top.i AS i), top.h AS subroot FROM p{k} p JOIN top ON top.own = p.tree)""")
        nodes, docs = ("top", f"q{k}") if k == levels else (f"t{k}", f"p{k}")
        steps.append(f"""r{k} AS MATERIALIZED (SELECT tree, i // 8 AS run, list(h ORDER BY i) AS hs, any_value(n) AS n FROM (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}) GROUP BY ALL),
t{k + 1} AS (SELECT tree, run AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r{k}),
p{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (run AS i, CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '') END AS proof,
  CASE WHEN n = 1 THEN fold ELSE sha256(array_to_string(hs[:i % 8], '') || fold || array_to_string(hs[i % 8 + 2:], '')) END AS fold) FROM {docs} p JOIN r{k} r ON r.tree = p.tree AND r.run = p.i // 8)""")
    k = levels + upper
    # a slice up to 0 is not empty in every version
    text = ",\n".join(steps).replace("array_to_string(hs[:i % 8], '')", "CASE WHEN i % 8 = 0 THEN '' ELSE array_to_string(hs[1:i % 8], '') END").replace("array_to_string(hs[i % 8 + 2:], '')", "CASE WHEN i % 8 + 2 > len(hs) THEN '' ELSE array_to_string(hs[i % 8 + 2:len(hs)], '') END")
    return f"WITH {text}\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified FROM p{k} JOIN t{k} r ON true"


def conversations() -> str:
    """Costs to the end by recursion backward over the rows of each conversation, then the first cheapest edit of each row by recursion forward."""
    code = crc32("place")
    return f"""WITH RECURSIVE a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
d AS MATERIALIZED (SELECT *, {code} % 20 AS k FROM a),
r AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, left(role, 1) AS c FROM r),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2
    WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY p) || c NOT IN ('su', 'ua', 'au'), false) AS odd FROM o),
s AS MATERIALIZED (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (odd) AS illegal FROM f GROUP BY conv_id),
b(conv_id, t, h) AS (SELECT conv_id, n, [0, 4, 2, 0] FROM s UNION ALL
  SELECT conv_id, t - 1, [least(x[1], 2 + least(x[3], 2 + x[4])), least(x[2], 2 + least(x[3], 2 + x[4])), least(x[3], 2 + x[4]), least(x[4], 2 + x[3])] FROM (
    SELECT b.conv_id, b.t, CASE WHEN fault IN (1, 2) THEN [3 + h[1], 3 + h[2], 3 + h[3], 3 + h[4]] ELSE [
      least(3 + h[1], e + CASE c WHEN 's' THEN h[2] WHEN 'u' THEN h[3] ELSE 2 + h[3] END), least(3 + h[2], e + CASE c WHEN 'u' THEN h[3] ELSE 2 + h[3] END),
      least(3 + h[3], e + CASE c WHEN 'a' THEN h[4] ELSE 2 + h[4] END), least(3 + h[4], e + CASE c WHEN 'u' THEN h[3] ELSE 2 + h[3] END)] END AS x
    FROM b JOIN (SELECT *, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS e FROM f) f ON f.conv_id = b.conv_id AND f.p = b.t)),
w(conv_id, t, s, audit, lines) AS (SELECT conv_id, 0::BIGINT, 1, '', []::VARCHAR[] FROM s UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN t ELSE t + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE nx END, audit || e,
    CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE nx WHEN 3 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END) END
  FROM (SELECT *, CASE WHEN role IS NOT NULL AND 3 + after[s] = h[s] THEN 'D' WHEN 2 + h[nx] = h[s] AND NOT (role IS NULL AND s IN (1, 4)) THEN 'I'
      WHEN role IS NOT NULL AND kept > 0 AND fault NOT IN (1, 2) AND after[kept] + CASE WHEN fault = 3 THEN 1 ELSE 0 END = h[s] THEN 'K' WHEN role IS NOT NULL THEN 'R' END AS e
    FROM (SELECT w.*, b.h, g.h AS after, f.role, f.text, f.fault, CASE s WHEN 3 THEN 4 ELSE 3 END AS nx, CASE WHEN s = 1 AND f.c = 's' THEN 2 WHEN s = 3 AND f.c = 'a' THEN 4 WHEN s <> 3 AND f.c = 'u' THEN 3 ELSE 0 END AS kept
      FROM w JOIN b ON b.conv_id = w.conv_id AND b.t = w.t LEFT JOIN f ON f.conv_id = w.conv_id AND f.p = w.t + 1 LEFT JOIN b g ON g.conv_id = w.conv_id AND g.t = w.t + 1)) WHERE e IS NOT NULL),
z AS (SELECT w.conv_id, w.audit, array_to_string(w.lines, chr(10)) AS lines FROM w JOIN s ON s.conv_id = w.conv_id AND s.n = w.t WHERE w.s IN (1, 4))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.h[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN z USING (conv_id) LEFT JOIN b ON b.conv_id = c.conv_id AND b.t = 0"""


ORACLES = {"op1_near_dedup": near_dedup(), "op3_warc": warc(), "op4_decontaminate": contained_items(), "op9_substring_dedup": substring_dedup(), "op12_repair_conversations": conversations(), "op13_merkle_manifest": merkle()}
