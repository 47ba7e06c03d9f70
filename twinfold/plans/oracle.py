"""The same jobs as SQL for DuckDB, written from the definitions and not from the Spark plans.

Pairs are found over all articles here, without grouping equal texts first, and
components by a recursive query.
"""

from __future__ import annotations

from hashlib import md5

# The MinHash modulus, permutations, bands and rows.
PRIME, PERMUTATIONS, BANDS, ROWS = 2**31 - 1, 120, 20, 6

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _title(text: str, fallback: str) -> str:
    line = rf"trim(regexp_extract(ltrim({text}, {_WS}), '^[^\n\r\x0b\x0c]*'), {_WS})"
    line = f"CASE WHEN {line} = '' THEN {fallback} ELSE {line} END"
    return f"CASE WHEN length({line}) > 120 THEN substr({line}, 1, 117) || '...' ELSE {line} END"


def _low32(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[24:], 16)


def _minhash() -> str:
    values = []
    for i in range(PERMUTATIONS):
        a, b = 1 + _low32(f"a{i}") % (PRIME - 1), _low32(f"b{i}") % PRIME
        values.append(f"min(({a} * h + {b}) % {PRIME}) AS m{i}")
    return ", ".join(values)


def _band_list() -> str:
    bands = []
    for band in range(BANDS):
        values = ", ".join(f"m{band * ROWS + r}" for r in range(ROWS))
        bands.append(f"{{'band': {band}, 'hash': substr(md5(concat_ws(',', {values})), 1, 8)}}")
    return "[" + ", ".join(bands) + "]"


_SIMHASH = " + ".join(
    f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::HUGEINT ELSE 0::HUGEINT END" for i in range(64)
)
_GRAMS = ", ".join(f"regexp_extract_all(substr(norm, {k}), '(?s).{{5}}')" for k in range(1, 6))

# name -> (names it needs, query)
CTES: dict[str, tuple[str, str]] = {
    "art": ("", f"""
        SELECT CAST(doc_id AS VARCHAR) AS article_id, {_title('text', 'CAST(doc_id AS VARCHAR)')} AS title, text AS content,
               1704067200 + (doc_id * 37) % 43200 * 60 AS published, source, lang, doc_id % 3 AS state,
               CASE WHEN doc_id % 10 = 0 THEN 1::BIGINT ELSE 0 END AS top,
               ['tag' || (doc_id % 7), 'tag' || (doc_id % 5)] AS tag_names,
               [CAST(1000 + doc_id % 7 AS VARCHAR), CAST(2000 + doc_id % 5 AS VARCHAR)] AS tag_ids,
               CASE WHEN doc_id % 4 = 3 THEN [] ELSE ['topic_' || lang] END AS topic_ids
        FROM documents"""),
    "nrm": ("art", f"SELECT article_id, lower(trim(title || ' ' || content, {_WS})) AS norm FROM art"),
    "tok": ("nrm", r"""
        SELECT article_id, ('0x' || substr(md5(w), 17, 16))::UBIGINT AS h
        FROM (SELECT article_id, unnest(string_split_regex(norm, '\s+')) AS w FROM nrm) WHERE w <> ''"""),
    "sh": ("tok", f"SELECT article_id, lower(lpad(to_hex(({_SIMHASH})::UBIGINT), 16, '0')) AS simhash FROM tok GROUP BY article_id"),
    "grams": ("nrm", f"SELECT article_id, flatten([{_GRAMS}]) AS g FROM nrm"),
    "sets": ("grams", "SELECT article_id, list_distinct(g) AS s FROM grams"),
    "mv": ("sets", f"""
        SELECT article_id, {_minhash()}
        FROM (SELECT article_id, ('0x' || substr(md5(g), 25, 8))::BIGINT % {PRIME} AS h FROM (SELECT article_id, unnest(s) AS g FROM sets))
        GROUP BY article_id"""),
    "bands": ("mv", f"SELECT article_id, b.band AS band, b.hash AS hash FROM (SELECT article_id, unnest({_band_list()}) AS b FROM mv)"),
    "cand": ("bands", """
        SELECT x.article_id AS a, y.article_id AS b, count(*) AS shared
        FROM bands x JOIN bands y ON x.band = y.band AND x.hash = y.hash AND x.article_id < y.article_id GROUP BY ALL"""),
    "scored": ("cand sets sh", """
        SELECT a, b, shared, common / (len(x.s) + len(y.s) - common) AS score, bit_count(xor(('0x' || p.simhash)::UBIGINT, ('0x' || q.simhash)::UBIGINT)) AS distance
        FROM (SELECT c.*, len(list_intersect(x.s, y.s))::DOUBLE AS common FROM cand c JOIN sets x ON x.article_id = a JOIN sets y ON y.article_id = b) c
        JOIN sets x ON x.article_id = a JOIN sets y ON y.article_id = b
        JOIN sh p ON p.article_id = a JOIN sh q ON q.article_id = b"""),
    "verified": ("scored", "SELECT * FROM scored WHERE score >= 0.8"),
    "equal": ("sh", """
        SELECT x.article_id AS a, y.article_id AS b FROM sh x JOIN sh y ON x.simhash = y.simhash AND x.article_id < y.article_id"""),
    "edge": ("verified equal", "SELECT a, b, score FROM verified UNION ALL SELECT a, b, 1.0 FROM equal"),
    "ends": ("edge", "SELECT a AS u, b AS v, score FROM edge UNION ALL SELECT b, a, score FROM edge"),
    "comp": ("ends", """
        SELECT u AS article_id, min(l) AS root FROM (
          WITH RECURSIVE r AS (SELECT u, least(u, v) AS l FROM ends UNION SELECT e.v, r.l FROM r JOIN ends e ON e.u = r.u)
          SELECT * FROM r) GROUP BY u"""),
    "assigned": ("art comp sh sets", """
        SELECT art.article_id, 'cluster_' || root AS cluster_id, CASE WHEN root IS NULL THEN 'unique' ELSE 'matched' END AS cluster_status,
               CASE WHEN root IS NULL THEN NULL WHEN alike > 1 OR article_id = root THEN 1.0
                 ELSE common / (n + root_n - common) END::DOUBLE AS similarity_score, title, content, published, source, state, top, tag_ids, topic_ids
        FROM art LEFT JOIN comp USING (article_id)
        LEFT JOIN (SELECT article_id, count(*) OVER (PARTITION BY simhash) AS alike FROM sh) USING (article_id)
        LEFT JOIN (
          SELECT c.article_id, len(list_intersect(x.s, y.s))::DOUBLE AS common, len(x.s) AS n, len(y.s) AS root_n
          FROM comp c JOIN sets x ON x.article_id = c.article_id JOIN sets y ON y.article_id = c.root) USING (article_id)"""),
    "words": ("art", r"""
        SELECT article_id, w, count(*) AS n, min(i) AS first FROM (
          SELECT article_id, unnest(l) AS w, generate_subscripts(l, 1) AS i
          FROM (SELECT article_id, string_split_regex(lower(title || ' ' || content), '\s+') AS l FROM art))
        WHERE length(w) > 1 GROUP BY article_id, w"""),
    "terms": ("words", """
        SELECT article_id, rank, w AS term, CAST(printf('%.3f', n / sum(n) OVER (PARTITION BY article_id)) AS DOUBLE) AS weight
        FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, first) AS rank FROM words) WHERE rank <= 10"""),
    "heads": ("assigned", """
        SELECT cluster_id, count(*) AS size, arg_min(article_id, (published, article_id)) AS representative,
               string_agg(article_id, ',' ORDER BY article_id) AS ids, min(published) + 2 AS created, max(published) + 2 AS updated
        FROM assigned WHERE cluster_id IS NOT NULL GROUP BY cluster_id"""),
    "reps": ("nrm", "SELECT min(article_id) AS article_id, norm, count(*) AS copies FROM nrm GROUP BY norm"),
    "dups": ("sh", """
        SELECT article_id, simhash, min(article_id) OVER w AS root, count(*) OVER w AS size FROM sh
        WINDOW w AS (PARTITION BY simhash) QUALIFY size > 1"""),
    "tpairs": ("verified reps", """
        SELECT v.* FROM verified v JOIN reps x ON x.article_id = a JOIN reps y ON y.article_id = b"""),
    "linked": ("verified dups", """
        SELECT p.article_id, p.other_id, p.score, 'cluster_' || root AS cluster_id
        FROM (SELECT a AS article_id, b AS other_id, score FROM verified UNION ALL SELECT b, a, score FROM verified) p
        LEFT JOIN dups ON dups.article_id = other_id"""),
    "ranked": ("assigned", """
        SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published DESC, article_id) AS rank
        FROM assigned WHERE cluster_id IS NOT NULL"""),
    "first100": ("assigned", """
        SELECT row_number() OVER (ORDER BY published DESC, article_id) AS position, * FROM assigned QUALIFY position <= 100"""),
    "titles": ("art", r"""
        SELECT article_id, published, list_distinct(list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS tokens FROM art"""),
}


def _sql(needs: str, final: str) -> str:
    """``final`` with the common table expressions it needs, each after its own needs."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in wanted:
            return
        for need in CTES[name][0].split():
            add(need)
        wanted.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1].strip()})" for name in wanted]
    final = final.strip()
    more = ", " if final.startswith(",") else " "  # a final part may open with further expressions
    return (f"WITH {', '.join(parts)}{more}" if parts else "") + final.removeprefix(",").strip()


_STATE = "article_id, cluster_id, cluster_status, similarity_score"
_HIT = "article_id, state, top, source, published AS publish_epoch"
_TOKENS = r"list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda t: t <> '')"

ORACLE: dict[str, str] = {
    # sources, updates, validation
    "articles_scan": _sql("art", """
        SELECT article_id, title, length(content) AS n_chars, published AS publish_epoch, source, state, top,
               array_to_string(tag_names, ',') AS tag_names, array_to_string(topic_ids, ',') AS topics, published + 2 AS created_epoch FROM art"""),
    "derive_title": _sql("art", "SELECT article_id, title FROM art"),
    "merge_updates": _sql("art", """
        SELECT article_id, source, CASE WHEN doc_id IS NULL THEN state ELSE toxic * 2 END AS state,
               CASE WHEN doc_id IS NULL THEN top ELSE quality END AS top, 'stored' AS kind
        FROM art LEFT JOIN labels ON CAST(doc_id AS VARCHAR) = article_id
        UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, toxic * 2, quality, 'rejected'
        FROM labels WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT article_id FROM art)"""),
    "upsert_articles": _sql("art", f"""
        , sent AS (
          SELECT CAST(conv_id AS VARCHAR) AS article_id, text AS content, 1709251200 + turn * 60 AS published, role AS source
          FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1
          UNION ALL SELECT 'item_' || item_id, text, 1709251200 + item_id * 60, 'benchmark' FROM benchmark),
        new AS (SELECT *, {_title('content', 'article_id')} AS title FROM sent)
        SELECT coalesce(n.article_id, o.article_id) AS article_id, coalesce(n.title, o.title) AS title,
               length(coalesce(n.content, o.content)) AS n_chars, coalesce(n.source, o.source) AS source,
               CASE WHEN n.article_id IS NULL THEN o.state ELSE 1 END AS state, coalesce(n.published, o.published) AS publish_epoch,
               coalesce(o.published + 2, n.published) AS created_epoch, coalesce(n.published, o.published + 2) AS updated_epoch,
               o.article_id IS NULL AS is_new,
               o.article_id IS NOT NULL AND n.article_id IS NOT NULL AND (o.title <> n.title OR o.content <> n.content) AS text_changed
        FROM art o FULL JOIN new n ON o.article_id = n.article_id"""),
    "lookup_articles": _sql("art", """
        SELECT article_id, title, source FROM art WHERE article_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""),
    "validate_articles": _sql("art", """
        SELECT article_id, CASE WHEN length(content) > 200000 THEN 'content_too_long' ELSE '' END AS reasons FROM art
        UNION ALL SELECT conv_id || '-' || turn, array_to_string(list_filter([
            CASE WHEN text IS NULL THEN 'title_missing' END, CASE WHEN text IS NULL THEN 'content_missing' END,
            CASE WHEN role IS NULL OR role = 'system' THEN 'source_missing' END,
            CASE WHEN length(text) > 200000 THEN 'content_too_long' END,
            CASE WHEN turn - 1 NOT BETWEEN 0 AND 2 THEN 'state_range' END,
            CASE WHEN turn NOT BETWEEN 0 AND 1 THEN 'top_range' END], lambda r: r IS NOT NULL), ',')
        FROM conversations"""),
    "valid_cluster_ids": _sql("art", f"""
        SELECT article_id, cluster_id, trim(article_id, {_WS}) <> '' AS ok_article, regexp_matches(cluster_id, '(?s)^cluster_.+$') AS ok_cluster
        FROM (SELECT article_id, unnest(['cluster_' || article_id, source, 'cluster_']) AS cluster_id FROM art)"""),
    "sanitize_text": _sql("art", rf"""
        SELECT article_id, length(t) AS n_chars, md5(t) AS digest
        FROM (SELECT article_id, substr(trim(regexp_replace(content, '\s+', ' ', 'g'), ' '), 1, 200000) AS t FROM art)"""),
    "normalize_source": _sql("", r"""
        SELECT regexp_replace(replace(replace(replace(lower(trim(' ' || upper(source) || ' - ' || lang || '.News ')), ' ', '_'), '-', '_'), '.', '_'), '_+', '_', 'g') AS source,
               count(*) AS articles FROM documents GROUP BY 1"""),
    "valid_languages": _sql("", r"""
        SELECT code, regexp_matches(code, '^(\p{L}\p{L}|\p{L}\p{L}-\p{L}\p{L})$') AS ok, count(*) AS articles
        FROM (SELECT unnest([lang, lang || '-' || upper(lang), lang || '_' || lang, source]) AS code FROM documents) GROUP BY ALL"""),
    "valid_ranges": _sql("", """
        SELECT l_linestatus, coalesce(o_orderdate <= l_shipdate, true) AS ok, count(*) AS ranges
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""),
    "tag_ids": _sql("art", "SELECT article_id, array_to_string(tag_ids, ',') AS tag_ids, array_to_string(topic_ids, ',') AS topic_ids FROM art"),
    # text features
    "normalize_text": _sql("nrm", "SELECT article_id, length(norm) AS n_chars, md5(norm) AS digest FROM nrm"),
    "shingles": _sql("nrm grams", """
        SELECT article_id, len(g) AS n_shingles, len(list_distinct(g)) AS n_distinct,
               CASE WHEN len(g) > 0 THEN substr(norm, 1, 5) END AS first_shingle,
               CASE WHEN len(g) > 0 THEN substr(norm, length(norm) - 4, 5) END AS last_shingle,
               list_min(g) AS low_shingle, list_max(g) AS high_shingle
        FROM grams JOIN nrm USING (article_id)"""),
    "simhash": _sql("sh", "SELECT article_id, simhash FROM sh"),
    "minhash_values": _sql("mv", f"""
        SELECT article_id, unnest(range({PERMUTATIONS})) AS position, unnest([{', '.join(f'm{i}' for i in range(PERMUTATIONS))}]) AS value FROM mv"""),
    "minhash_bands": _sql("bands", "SELECT article_id, band::BIGINT AS band, hash AS band_hash FROM bands"),
    "extract_features": _sql("sh sets bands", """
        SELECT article_id, simhash, coalesce(signature, '') AS minhash_signature, len(s) AS n_shingles FROM sh JOIN sets USING (article_id)
        LEFT JOIN (SELECT article_id, string_agg(hash, ',' ORDER BY band) AS signature FROM bands GROUP BY article_id) USING (article_id)"""),
    "top_terms": _sql("terms", "SELECT article_id, rank, term, weight FROM terms"),
    # candidates and similarity
    "simhash_duplicates": _sql("dups", "SELECT article_id, simhash, root AS first_id, size AS group_size FROM dups"),
    "lsh_candidates": _sql("cand reps", """
        SELECT a AS article_id_a, b AS article_id_b, shared AS shared_bands
        FROM cand JOIN reps x ON x.article_id = a JOIN reps y ON y.article_id = b"""),
    "lsh_topk": _sql("cand", """
        SELECT article_id, candidate_id, shared AS shared_bands, row_number() OVER (PARTITION BY article_id ORDER BY shared DESC, candidate_id) AS rank
        FROM (SELECT a AS article_id, b AS candidate_id, shared FROM cand UNION ALL SELECT b, a, shared FROM cand) QUALIFY rank <= 50"""),
    "hamming_pairs": _sql("scored reps", """
        SELECT a AS article_id_a, b AS article_id_b, distance::BIGINT AS distance
        FROM scored JOIN reps x ON x.article_id = a JOIN reps y ON y.article_id = b"""),
    "simhash_near": _sql("sh", """
        , v AS (SELECT simhash, ('0x' || simhash)::UBIGINT AS h, count(*) AS n FROM sh GROUP BY simhash)
        SELECT x.simhash AS simhash_low, y.simhash AS simhash_high, bit_count(xor(x.h, y.h))::BIGINT AS distance, x.n * y.n AS article_pairs
        FROM v x JOIN v y ON x.simhash < y.simhash WHERE bit_count(xor(x.h, y.h)) <= 3"""),
    "jaccard_pairs": _sql("scored reps", """
        SELECT a AS article_id_a, b AS article_id_b, score FROM scored JOIN reps x ON x.article_id = a JOIN reps y ON y.article_id = b"""),
    "similar_pairs": _sql("tpairs", "SELECT a AS article_id_a, b AS article_id_b, shared AS shared_bands, score FROM tpairs"),
    "classify_articles": _sql("nrm scored", """
        SELECT article_id, CASE WHEN near THEN 'duplicate' WHEN best >= 0.8 THEN 'similar' ELSE 'unique' END AS verdict,
               CASE WHEN near THEN 1.0 WHEN best >= 0.8 THEN best ELSE 0.0 END::DOUBLE AS score
        FROM nrm LEFT JOIN (
          SELECT article_id, bool_or(distance <= 3) AS near, max(score) AS best
          FROM (SELECT a AS article_id, distance, score FROM scored UNION ALL SELECT b, distance, score FROM scored) GROUP BY article_id)
        USING (article_id)"""),
    # clustering
    "components": _sql("tpairs reps sh", """
        , node AS (SELECT article_id, simhash FROM reps JOIN sh USING (article_id)),
        link AS (
          SELECT a AS u, b AS v FROM tpairs UNION SELECT b, a FROM tpairs
          UNION SELECT x.article_id, y.article_id FROM node x JOIN node y ON x.simhash = y.simhash AND x.article_id <> y.article_id),
        walk AS (SELECT * FROM (
          WITH RECURSIVE r AS (SELECT u, least(u, v) AS l FROM link UNION SELECT e.v, r.l FROM r JOIN link e ON e.u = r.u) SELECT * FROM r))
        SELECT u AS article_id, min(l) AS component FROM walk GROUP BY u"""),
    "article_components": _sql("comp", "SELECT article_id, root AS component FROM comp"),
    "text_members": _sql("nrm", """
        SELECT article_id, min(article_id) OVER (PARTITION BY norm) AS representative, count(*) OVER (PARTITION BY norm) AS copies FROM nrm"""),
    "cluster_articles": _sql("assigned", f"SELECT {_STATE} FROM assigned"),
    "cluster_articles_exact": _sql("art verified nrm sets", """
        , e AS (SELECT a AS u, b AS v FROM verified UNION ALL SELECT b, a FROM verified),
        walk AS (SELECT * FROM (
          WITH RECURSIVE r AS (SELECT u, least(u, v) AS l FROM e UNION SELECT e.v, r.l FROM r JOIN e ON e.u = r.u) SELECT * FROM r))
        SELECT article_id, 'cluster_' || root AS cluster_id, CASE WHEN root IS NULL THEN 'unique' ELSE 'matched' END AS cluster_status,
               CASE WHEN root IS NULL THEN NULL WHEN article_id = root OR count(*) OVER (PARTITION BY norm) > 1 THEN 1.0
                 ELSE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE END::DOUBLE AS similarity_score
        FROM art LEFT JOIN (SELECT u AS article_id, min(l) AS root FROM walk GROUP BY u) USING (article_id)
        LEFT JOIN nrm USING (article_id) LEFT JOIN sets x USING (article_id)
        LEFT JOIN (SELECT article_id AS root, s FROM sets) y USING (root)"""),
    "clusters": _sql("heads terms", """
        SELECT cluster_id, size, representative AS representative_article_id,
               coalesce(top_terms, '') AS top_terms, created AS created_epoch, updated AS updated_epoch
        FROM heads LEFT JOIN (
          SELECT article_id AS representative, string_agg(term || '=' || printf('%.3f', weight), ' ' ORDER BY rank) AS top_terms FROM terms GROUP BY article_id)
        USING (representative)"""),
    "duplicate_clusters": _sql("dups", "SELECT article_id, 'cluster_' || root AS cluster_id, 1.0::DOUBLE AS similarity_score FROM dups"),
    "merge_members": _sql("linked", """
        SELECT cluster_id, article_id, count(*) OVER (PARTITION BY cluster_id) AS size
        FROM (SELECT 'cluster_' || root AS cluster_id, article_id FROM dups UNION SELECT cluster_id, article_id FROM linked WHERE cluster_id IS NOT NULL)"""),
    "best_cluster": _sql("linked", """
        SELECT article_id, cluster_id, round(avg(score), 9) AS avg_score, count(*) AS articles FROM linked WHERE cluster_id IS NOT NULL
        GROUP BY article_id, cluster_id QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY round(avg(score), 9) DESC, cluster_id) = 1"""),
    "unmatched_articles": _sql("assigned", "SELECT article_id FROM assigned WHERE cluster_status = 'unique'"),
    "recheck": _sql("art verified sh sets", """
        , e AS (SELECT a AS u, b AS v, score FROM verified UNION ALL SELECT b, a, score FROM verified),
        walk AS (SELECT * FROM (
          WITH RECURSIVE r AS (SELECT u, least(u, v) AS l FROM e UNION SELECT e.v, r.l FROM r JOIN e ON e.u = r.u) SELECT * FROM r))
        SELECT article_id, 'cluster_' || root AS cluster_id, CASE WHEN root IS NULL THEN 'unique' ELSE 'matched' END AS cluster_status,
               CASE WHEN root IS NULL THEN NULL WHEN article_id = root OR count(*) OVER (PARTITION BY root, simhash) > 1 THEN 1.0
                 ELSE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE END::DOUBLE AS similarity_score
        FROM art LEFT JOIN (SELECT u AS article_id, min(l) AS root FROM walk GROUP BY u) USING (article_id)
        LEFT JOIN sh USING (article_id) LEFT JOIN sets x USING (article_id)
        LEFT JOIN (SELECT article_id AS root, s FROM sets) y USING (root)"""),
    "recheck_some": _sql("assigned verified sh sets", """
        , again AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS article_id FROM labels),
        pos AS (
          SELECT a.article_id, CASE WHEN s.article_id IS NOT NULL OR a.cluster_id IS NULL THEN '~' || a.article_id ELSE a.cluster_id END AS node
          FROM assigned a LEFT JOIN again s USING (article_id)),
        e AS (
          SELECT x.node AS u, y.node AS v FROM verified JOIN pos x ON x.article_id = a JOIN pos y ON y.article_id = b
          WHERE a IN (SELECT article_id FROM again) OR b IN (SELECT article_id FROM again)),
        linked AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        walk AS (SELECT * FROM (
          WITH RECURSIVE r AS (SELECT u, least(u, v) AS l FROM linked UNION SELECT w.v, r.l FROM r JOIN linked w ON w.u = r.u) SELECT * FROM r)),
        root AS (SELECT u AS node, min(l) AS l FROM walk GROUP BY u),
        named AS (
          SELECT article_id, CASE WHEN coalesce(l, node) NOT LIKE '~%' THEN coalesce(l, node)
            WHEN l IS NULL THEN NULL ELSE 'cluster_' || min(article_id) OVER (PARTITION BY coalesce(l, node)) END AS cluster_id
          FROM pos LEFT JOIN root USING (node)),
        placed AS (SELECT *, min(article_id) OVER (PARTITION BY cluster_id) AS rep, count(*) OVER (PARTITION BY cluster_id, simhash) AS alike
          FROM named JOIN sh USING (article_id))
        SELECT article_id, cluster_id, CASE WHEN cluster_id IS NULL THEN 'unique' ELSE 'matched' END AS cluster_status,
               CASE WHEN cluster_id IS NULL THEN NULL WHEN article_id = rep OR alike > 1 THEN 1.0
                 ELSE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))::DOUBLE END::DOUBLE AS similarity_score
        FROM placed JOIN sets x USING (article_id) JOIN (SELECT article_id AS rep, s FROM sets) y USING (rep)"""),
    # statistics
    "corpus_totals": _sql("assigned", "SELECT count(*) AS total_articles, count(DISTINCT cluster_id) AS total_clusters FROM assigned"),
    "size_distribution": _sql("heads", "SELECT size, count(*) AS clusters FROM heads GROUP BY size"),
    "status_counts": _sql("assigned", "SELECT cluster_status, count(*) AS articles FROM assigned GROUP BY 1"),
    "stale_pending": _sql("art", """
        SELECT article_id, 1704067200 + 15 * 86400 - (published + 2) AS age_seconds FROM art
        WHERE 1704067200 + 15 * 86400 - (published + 2) > 5 * 86400"""),
    # search
    "search_articles": _sql("art", f"""
        SELECT {_HIT} FROM art WHERE state = 1 AND list_contains({_TOKENS}, 'the') AND published BETWEEN 1704412800 AND 1706140800
        AND list_has_any(topic_ids, ['topic_en', 'topic_fr'])"""),
    "search_state": _sql("art", f"SELECT {_HIT} FROM art WHERE state = 0 AND top = 0"),
    "search_source": _sql("art", f"SELECT {_HIT} FROM art WHERE source = 'src3'"),
    "search_tag": _sql("art", f"SELECT {_HIT} FROM art WHERE list_contains(tag_ids, '1003')"),
    "search_topics": _sql("art", f"SELECT {_HIT} FROM art WHERE list_has_any(topic_ids, ['topic_de', 'topic_es'])"),
    "search_time_range": _sql("art", f"SELECT {_HIT} FROM art WHERE published >= 1704844800 AND published <= 1705708800"),
    "search_title": _sql("art", f"SELECT {_HIT} FROM art WHERE list_has_all({_TOKENS}, ['the', 'and'])"),
    "search_sort": _sql("assigned", """
        SELECT row_number() OVER (ORDER BY published, article_id) AS position, article_id, cluster_id, published AS publish_epoch
        FROM assigned QUALIFY position <= 100"""),
    "search_page": _sql("assigned", """
        SELECT row_number() OVER (ORDER BY published DESC, article_id) AS position, article_id, cluster_id, published AS publish_epoch,
               count(*) OVER () AS total, ceil(count(*) OVER () / 20)::BIGINT AS total_pages
        FROM assigned WHERE state = 1 QUALIFY position BETWEEN 21 AND 40"""),
    "search_ranked_page": _sql("assigned", """
        SELECT row_number() OVER (ORDER BY published DESC, article_id) AS position, article_id, cluster_id, published AS publish_epoch
        FROM assigned, (SELECT greatest(1, (SELECT count(*) FROM assigned) // 50 // 2) AS page)
        QUALIFY position BETWEEN page * 50 - 49 AND page * 50"""),
    "paginate": _sql("heads", """
        SELECT row_number() OVER (ORDER BY size DESC, cluster_id) AS position, cluster_id, size FROM heads QUALIFY position BETWEEN 26 AND 50"""),
    "search_collapse": _sql("first100", """
        SELECT position, article_id, cluster_id, published AS publish_epoch FROM first100
        QUALIFY row_number() OVER (PARTITION BY coalesce(cluster_id, article_id) ORDER BY position) = 1"""),
    "search_similar_ids": _sql("first100 ranked", """
        , hit AS (SELECT * FROM first100 QUALIFY row_number() OVER (PARTITION BY coalesce(cluster_id, article_id) ORDER BY position) = 1)
        SELECT position, article_id, 0::BIGINT AS rank, article_id AS similar_article_id FROM hit
        UNION ALL SELECT position, h.article_id, r.rank, r.article_id FROM hit h JOIN ranked r ON r.cluster_id = h.cluster_id AND r.article_id <> h.article_id"""),
    # answers
    "article_detail": _sql("assigned heads", f"""
        SELECT {_STATE}, state, top, size AS cluster_size, representative FROM assigned LEFT JOIN heads USING (cluster_id)"""),
    "similar_articles": _sql("assigned ranked", """
        SELECT a.article_id, r.article_id AS similar_id, r.title, r.similarity_score, row_number() OVER (PARTITION BY a.article_id ORDER BY r.rank) AS rank
        FROM assigned a JOIN ranked r ON a.cluster_id = r.cluster_id AND a.article_id <> r.article_id AND r.rank <= 100"""),
    "similar_members": _sql("ranked", "SELECT article_id, cluster_id, rank, title, similarity_score FROM ranked"),
    "similar_articles_by_id": _sql("assigned ranked", """
        SELECT a.article_id, r.article_id AS similar_id, r.title, r.similarity_score, row_number() OVER (PARTITION BY a.article_id ORDER BY r.rank) AS rank
        FROM assigned a JOIN ranked r ON a.cluster_id = r.cluster_id AND a.article_id <> r.article_id
        WHERE a.article_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)"""),
    "cluster_detail": _sql("heads ranked", """
        SELECT cluster_id, size, representative AS representative_article_id, rank, article_id, cluster_status, similarity_score
        FROM heads JOIN ranked USING (cluster_id)"""),
    "cluster_members": _sql("ranked", "SELECT cluster_id, rank, article_id, published AS publish_epoch FROM ranked"),
    # streaming
    "incremental_clusters": _sql("assigned", f"SELECT {_STATE} FROM assigned"),
    "stream_rejects": _sql("", """
        SELECT * FROM (SELECT conv_id || '-' || turn AS article_id, array_to_string(list_filter([
            CASE WHEN text IS NULL THEN 'title_missing' END, CASE WHEN text IS NULL THEN 'content_missing' END,
            CASE WHEN role IS NULL OR role = 'system' THEN 'source_missing' END,
            CASE WHEN length(text) > 200000 THEN 'content_too_long' END,
            CASE WHEN turn - 1 NOT BETWEEN 0 AND 2 THEN 'state_range' END,
            CASE WHEN turn NOT BETWEEN 0 AND 1 THEN 'top_range' END], lambda r: r IS NOT NULL), ',') AS reasons
        FROM conversations) WHERE reasons <> ''"""),
    # quality reports
    "peer_recall": _sql("assigned", """
        SELECT article_id, count(*) OVER (PARTITION BY content) - 1 AS expected,
               CASE WHEN cluster_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY content, cluster_id) - 1 END AS found,
               CASE WHEN cluster_id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY content, cluster_id) - 1 END = count(*) OVER (PARTITION BY content) - 1 AS passed
        FROM assigned"""),
    "cluster_consistency": _sql("assigned heads", """
        SELECT cluster_id, claimed, size AS listed, greatest(claimed - size, 0) AS missing
        FROM heads FULL JOIN (SELECT cluster_id, count(*) AS claimed FROM assigned WHERE cluster_id IS NOT NULL GROUP BY 1) USING (cluster_id)"""),
    "lsh_recall": _sql("reps sets cand", """
        , kept AS (SELECT article_id, s, len(s) AS n FROM reps JOIN sets USING (article_id) WHERE len(s) > 0),
        el AS (SELECT article_id, n, unnest(s) AS g FROM kept),
        freq AS (SELECT g, count(*) AS f FROM el GROUP BY g),
        rare AS (SELECT article_id, n, g, row_number() OVER (PARTITION BY article_id ORDER BY f, g) AS r FROM el JOIN freq USING (g)),
        pre AS (SELECT * FROM rare WHERE r <= n - ceil(0.8 * n - 1e-6) + 1),
        near AS (
          SELECT DISTINCT x.article_id AS a, y.article_id AS b FROM pre x JOIN pre y
          ON x.g = y.g AND x.article_id < y.article_id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-6),
        common AS (
          SELECT a, b, x.n AS n, y.n AS m, len(list_intersect(x.s, y.s))::DOUBLE AS c
          FROM near JOIN kept x ON x.article_id = a JOIN kept y ON y.article_id = b),
        alike AS (SELECT a, b, c / (n + m - c) AS score FROM common WHERE c / (n + m - c) >= 0.8)
        SELECT CAST(least(floor(score * 20), 19) * 5 AS BIGINT) AS from_percent, count(*) AS pairs, count(shared) AS found,
               count(shared) / count(*) AS recall
        FROM alike LEFT JOIN cand USING (a, b) GROUP BY 1"""),
    "title_self_search": _sql("titles", """
        SELECT q.article_id, rank IS NOT NULL AS found, rank FROM titles q LEFT JOIN (
          SELECT article_id, 1 + (SELECT count(*) FROM titles d WHERE list_has_all(d.tokens, x.tokens) AND (d.published > x.published OR (d.published = x.published AND d.article_id < x.article_id))) AS rank
          FROM titles x WHERE len(x.tokens) > 0) r ON r.article_id = q.article_id AND rank <= 50"""),
}
