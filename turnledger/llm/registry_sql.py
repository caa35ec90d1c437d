"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations


def _race(shards: int) -> str:
    """Smallest (arrival time, shard) over the first ``shards`` shards of equal weight."""
    return (f"list_min(list_transform(range({shards}), lambda i: {{'time': -ln((('0x' || substr(md5(doc_id || ':' || i), 1, 13))"
            f"::BIGINT::DOUBLE + 0.5) / 4503599627370496.0), 'shard': i}})).shard::INTEGER")


# Slot by slot simulation of the mix: released blocks of classes with rows left, earliest deadline first.
_OP2 = """
WITH RECURSIVE classed AS (
  SELECT doc_id, source, CASE WHEN regexp_full_match(coalesce(source, ''), 'src(1?[0-9])') THEN source ELSE 'other' END AS mix_class,
         substr(md5(doc_id::VARCHAR), 1, 3) AS bucket
  FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY mix_class ORDER BY bucket, doc_id) - 1 AS row_in_class FROM classed),
classes AS (
  SELECT list(mix_class ORDER BY mix_class) AS names, list(blocks ORDER BY mix_class) AS blocks,
         list(CASE WHEN mix_class = 'other' THEN 1 ELSE 2 + substr(mix_class, 4)::INT % 4 END ORDER BY mix_class) AS weights
  FROM (SELECT mix_class, (count(*) + 63) // 64 AS blocks FROM numbered GROUP BY mix_class)),
run AS (
  SELECT 0 AS t, 0 AS start, list_transform(blocks, lambda b: 0) AS served, blocks AS remaining, NULL::BIGINT AS chosen,
         NULL::BIGINT AS block, NULL::BIGINT AS release, NULL::BIGINT AS due, NULL::BIGINT AS slot
  FROM classes
  UNION ALL
  SELECT t + 1, CASE WHEN remaining[pick] = 1 THEN t + 1 ELSE start END,
         list_transform(served, lambda s, i: CASE WHEN remaining[pick] = 1 THEN 0 WHEN i = pick THEN s + 1 ELSE s END),
         list_transform(remaining, lambda r, i: CASE WHEN i = pick THEN r - 1 ELSE r END), pick,
         blocks[pick] - remaining[pick], start + served[pick] * w // weights[pick],
         start + ((served[pick] + 1) * w + weights[pick] - 1) // weights[pick], t
  FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(weights) + 1), lambda i: CASE
             WHEN remaining[i] > 0 AND served[i] * w // weights[i] <= t - start
             THEN {'due': ((served[i] + 1) * w + weights[i] - 1) // weights[i], 'i': i} END), lambda x: x IS NOT NULL)).i AS pick
    FROM (SELECT *, list_sum(list_transform(weights, lambda v, i: CASE WHEN remaining[i] > 0 THEN v ELSE 0 END))::BIGINT AS w
          FROM run, classes WHERE list_sum(remaining) > 0))),
slots AS (SELECT names[chosen] AS mix_class, block, release, due, slot FROM run, classes WHERE chosen IS NOT NULL)
SELECT doc_id, source, n.mix_class, row_in_class, n.row_in_class // 64 AS block, release, due, slot, row_in_class % 64 AS place
FROM numbered n JOIN slots s ON s.mix_class = n.mix_class AND s.block = n.row_in_class // 64"""

_CRC_TABLE = """crc_table AS (  -- CRC-32, polynomial 0xEDB88320, one entry per byte
  SELECT list(value ORDER BY byte) AS t FROM (
    SELECT byte, list_reduce(list_prepend(byte, range(8)),
             lambda v, bit: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)) AS value
    FROM range(256) AS r(byte)))"""


def _leaf(text: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
             for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _others(hashes: str, place: str) -> tuple[str, str]:
    return f"array_to_string({hashes}[1:{place}], '')", f"array_to_string({hashes}[{place} + 2:], '')"


def _climb(start: str, runs: str, match: str) -> str:
    before, after = _others("hs", "c.i % 3")
    return f"""{start}
  UNION ALL
  SELECT c.doc_id, c.source, c.l + 1, c.i // 3, sha256({before} || c.h || {after}), c.proof || {before} || {after}
  FROM {{self}} c JOIN {runs} r ON r.l = c.l AND r.run = c.i // 3{match}"""


_OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
marked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda p: unicode(substr(doc_id::VARCHAR, p, 1))::BIGINT)),
              lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1])), 4294967295) % 2 = 0 AS bends
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("(CASE WHEN bends THEN replace(text, chr(10), '') ELSE text END)")} AS bent,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM marked),
tree AS (
  SELECT source, 0 AS l, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT source, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, l, i // 3, n),
subroots AS (
  SELECT source, h AS subroot, l, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS l, j AS i, subroot AS h, m AS n FROM subroots
  UNION ALL
  SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY l, i // 3, n),
runs AS (SELECT source, l, i // 3 AS run, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY source, l, i // 3),
top_runs AS (SELECT l, i // 3 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY l, i // 3),
low AS ({_climb("SELECT doc_id, source, 0 AS l, i, bent AS h, '' AS proof FROM leaves", "runs", " AND r.source IS NOT DISTINCT FROM c.source").format(self="low")}),
high AS ({_climb("SELECT low.doc_id, low.source, 0 AS l, s.j AS i, low.h, low.proof FROM low JOIN subroots s ON s.source IS NOT DISTINCT FROM low.source AND s.l = low.l", "top_runs", "").format(self="high")})
SELECT leaves.doc_id, leaves.leaf, subroot, top.h AS root, sha256(high.proof) AS proof_sha256, high.h AS folded_root, high.h = top.h AS verified
FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source JOIN top ON top.n = 1 JOIN high ON high.doc_id = leaves.doc_id AND high.l = top.l"""

SQL = {
    "op11_merkle_manifest": _OP11,
    "op2_mixing": _OP2,
    "op3_sharding": f"""
WITH placed AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS text,
         {_race(8)} AS shard, {_race(9)} AS grown_shard, substr(md5(doc_id::VARCHAR), 1, 3) AS bucket
  FROM documents),
{_CRC_TABLE}
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295,
             list_transform(range(0, octet_length(encode(text)) * 2, 2), lambda i: ('0x' || substr(hex(encode(text)), i + 1, 2))::BIGINT)),
             lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
       'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id) - 1 AS slot
FROM placed, crc_table""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sets AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, arcs.b FROM reach r JOIN arcs ON arcs.a = r.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON node = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
arcs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, arcs.b FROM reach r JOIN arcs ON arcs.a = r.seen),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM arcs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON node = vec_id LEFT JOIN degree ON a = vec_id""",
    "op9_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content, length(coalesce(text, '')) AS n
  FROM documents),
classes AS (
  SELECT content, count(*) AS group_size, min(doc_id) FILTER (n = most) AS keep_id
  FROM (SELECT *, max(n) OVER (PARTITION BY content) AS most FROM rows) GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM rows JOIN classes USING (content)""",
}
