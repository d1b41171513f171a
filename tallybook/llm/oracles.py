"""DuckDB twins of the queries that SQL can express."""

from tallybook.llm import licences

ORACLES: dict[str, str] = {}

ORACLES["op3_mixing"] = r"""
WITH sizes AS (
    SELECT doc_id, source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
    FROM documents
), keyed AS (
    SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id || ':', '') || size), 1, 2))::INT AS bucket
    FROM sizes
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
    FROM sizes GROUP BY source
), caps AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(size) FROM sizes) AS budget
    FROM sources
), leveled AS (
    SELECT *,
           (budget - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER onward AS level
    FROM caps
    WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           onward AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), chosen AS (
    SELECT level FROM leveled WHERE cap / weight >= level ORDER BY cap / weight, source LIMIT 1
), targets AS (
    SELECT c.*, CASE WHEN weight * level > cap THEN cap ELSE weight * level END AS target
    FROM caps AS c, (SELECT coalesce(max(level), 'infinity'::DOUBLE) AS level FROM chosen)
), plans AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies
    FROM targets
), lefts AS (
    SELECT *, floor(target)::BIGINT - copies * source_size AS more FROM plans
), buckets AS (
    SELECT source, bucket, sum(size)::BIGINT AS held,
           coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
    FROM keyed GROUP BY source, bucket
), cuts AS (
    SELECT b.source, b.bucket AS cut, more - ahead AS rest, held
    FROM buckets AS b JOIN lefts AS l ON b.source IS NOT DISTINCT FROM l.source
    WHERE ahead <= more AND ahead + held > more
), parts AS (
    SELECT k.doc_id, k.size, l.source_size, l.target, l.copies,
           CASE WHEN cut IS NULL OR bucket > cut THEN 0
                WHEN bucket < cut THEN k.size ELSE k.size * rest // held END::BIGINT AS part
    FROM keyed AS k JOIN lefts AS l ON k.source IS NOT DISTINCT FROM l.source
    LEFT JOIN cuts AS c ON k.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target, copies * size + part AS taken, copies, part FROM parts
"""

ORACLES["op10_repeats"] = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 19], ' ')) AS run
    FROM texts, unnest(range(1, len(words) - 18)) AS u(pos)
), repeats AS (
    SELECT doc_id, pos FROM windows
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1
), gone AS (
    SELECT DISTINCT doc_id, pos + step AS pos FROM repeats, range(20) AS r(step)
), single AS (
    SELECT doc_id, pos, words[pos] AS word FROM texts, unnest(range(1, len(words) + 1)) AS u(pos)
), kept AS (
    SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.pos) AS kept, count(*) AS n
    FROM single AS s ANTI JOIN gone AS g ON s.doc_id = g.doc_id AND s.pos = g.pos
    GROUP BY s.doc_id
)
SELECT t.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts AS t LEFT JOIN kept AS k ON t.doc_id = k.doc_id
"""

ORACLES["op2_top_k"] = r"""
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id,
       row_number() OVER (PARTITION BY q.vec_id
           ORDER BY list_inner_product(q.vec, c.vec) DESC, c.vec_id)::INT AS rank,
       c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
FROM vectors AS q JOIN vectors AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
QUALIFY rank <= 10
"""

ORACLES["op5_jaccard_join"] = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 3], ' ') AS shingle
    FROM texts, unnest(range(1, greatest(len(words) - 2, 2))) AS u(pos)
    WHERE len(words) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
    FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY ALL
), links AS (
    SELECT x, y FROM met AS o JOIN sizes AS a ON a.doc_id = x JOIN sizes AS b ON b.doc_id = y
    WHERE 100 * common >= 85 * (a.n + b.n - common)
), reach AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION
    SELECT node, y FROM reach JOIN links ON x = seen
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(seen) AS component_id
FROM documents AS d JOIN reach ON node = d.doc_id LEFT JOIN sizes AS s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, n
"""

_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in sorted(licences.TEMPLATES.items()))
ORACLES["op9_licences"] = rf"""
WITH passages AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS passage FROM documents
    UNION ALL
    SELECT doc_id, text FROM documents WHERE contains(text, chr(10))
), units AS (
    SELECT doc_id, passage, row_number() OVER () AS unit FROM passages
), templates AS (
    SELECT col0 AS licence, col1 AS passage FROM (VALUES {_TEMPLATES})
), texts AS (
    SELECT doc_id, unit, NULL AS licence, passage FROM units
    UNION ALL
    SELECT NULL, NULL, licence, passage FROM templates
), split AS (
    SELECT doc_id, unit, licence, regexp_extract_all(
               translate(passage, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[a-z0-9]+') AS words
    FROM texts
), pairs AS (
    SELECT doc_id, unit, licence, words[i] || ' ' || words[i + 1] AS pair, len(words) - 1 AS size
    FROM split, unnest(range(1, len(words))) AS u(i)
), counted AS (
    SELECT doc_id, unit, licence, pair, size, count(*) AS n FROM pairs GROUP BY ALL
), scores AS (
    SELECT a.doc_id, a.unit, b.licence,
           2 * sum(least(a.n, b.n))::DOUBLE / (a.size + b.size) AS score
    FROM counted AS a JOIN counted AS b ON a.pair = b.pair
    WHERE a.licence IS NULL AND b.licence IS NOT NULL
    GROUP BY a.doc_id, a.unit, a.size, b.licence, b.size
), best AS (
    SELECT doc_id, unit, licence, score FROM scores WHERE score >= {licences.THRESHOLD}
    QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence) = 1
), single AS (
    SELECT doc_id, count(*) AS n_passages,
           array_to_string(list_sort(list_distinct(list(licence))), ',') AS licences,
           max(score) AS best_score
    FROM best GROUP BY doc_id
)
SELECT DISTINCT d.doc_id, coalesce(n_passages, 0)::BIGINT AS n_passages,
       coalesce(licences, '') AS licences, best_score
FROM documents AS d LEFT JOIN single AS s ON d.doc_id = s.doc_id
"""

ORACLES["op11_near_vectors"] = r"""
WITH RECURSIVE vectors AS (
    SELECT row_number() OVER () AS node, vec_id, label,
           list_transform(embedding, lambda x: x::DOUBLE) AS vec
    FROM embeddings
), usable AS (
    SELECT *, sqrt(list_inner_product(vec, vec)) AS norm
    FROM vectors
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(vec) > 0
      AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(vec, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.node AS x, b.node AS y, b.vec_id AS other
    FROM usable AS a JOIN usable AS b ON a.label = b.label AND len(a.vec) = len(b.vec) AND a.node <> b.node
    WHERE list_inner_product(a.vec, b.vec) / (a.norm * b.norm) >= 0.98
), reach AS (
    SELECT node, node AS seen FROM vectors
    UNION
    SELECT node, y FROM reach JOIN links ON x = seen
), least AS (
    SELECT r.node, min(v.vec_id) AS component_id FROM reach AS r JOIN vectors AS v ON v.node = r.seen
    GROUP BY r.node
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.node)::BIGINT AS n_links, component_id,
       coalesce(v.vec_id = component_id, true) AS kept
FROM vectors AS v JOIN least USING (node)
"""

ORACLES["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
    SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, words[i:i+k-1] AS gram, count(*)::BIGINT AS f
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
          FROM lists, (VALUES (1), (2), (3)) AS s(k))
    GROUP BY ALL
), sizes AS (
    SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT * FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.phrase, c.k, c.gram, c.f AS a, l.f AS l, r.f AS r,
           (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score, cut
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) AS c
    JOIN grams AS l ON l.lang = c.lang AND l.gram = c.gram[1:cut]
    JOIN grams AS r ON r.lang = c.lang AND r.gram = c.gram[cut + 1:]
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1
), inside AS (
    SELECT DISTINCT s.lang, s.gram
    FROM (SELECT lang, f, unnest([gram[1:2], gram[2:3]]) AS gram FROM candidates WHERE k = 3) AS o
    JOIN scored AS s ON s.lang = o.lang AND s.gram = o.gram AND 100 * o.f >= 50 * s.a
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, score
    FROM scored ANTI JOIN inside USING (lang, gram)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
