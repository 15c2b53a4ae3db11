"""DuckDB SQL with the rows of the registered operators that SQL can express."""

from __future__ import annotations

from timeweave.llm import licenses, url_cascade
from timeweave.llm.decontam import Search
from timeweave.llm.mixing import Mix

UPPER, LOWER = licenses.UPPER, licenses.LOWER


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    line = f"trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), {quoted(licenses.NOT_WORD)}, ' ', 'g'))"
    for spelling, canonical in licenses.SPELLINGS:
        line = f"replace({line}, '{spelling}', '{canonical}')"
    lines = f"[y for y in [{line} for x in string_split(coalesce(text, ''), chr(10))] if y <> '' and not regexp_matches(y, {quoted(licenses.COPYRIGHT_LINE)})]"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.KNOWN)
    told = ", ".join(f"({quoted(name)}, {quoted(digest)})" for name, digest in licenses.KNOWN_DIGESTS)
    return f"""
    WITH known AS (SELECT sha256(array_to_string({lines}, ' ')) AS digest, name FROM (VALUES {known}) t(name, text) UNION ALL SELECT digest, name FROM (VALUES {told}) t(name, digest)),
    names AS (SELECT digest, list_sort(list(DISTINCT name)) AS licenses FROM known GROUP BY digest),
    docs AS (SELECT doc_id, {lines} AS lines FROM documents),
    hits AS (SELECT doc_id, unnest(licenses) AS name, i FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs) l JOIN names ON sha256(line) = digest),
    notices AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(DISTINCT i) AS n FROM hits GROUP BY doc_id)
    SELECT d.doc_id, array_to_string(w.licenses, ',') AS license, coalesce(n.notices, '') AS notices, coalesce(n.n, 0) AS n_notice_lines
    FROM docs d LEFT JOIN names w ON sha256(array_to_string(d.lines, ' ')) = w.digest LEFT JOIN notices n USING (doc_id)
    """


def contamination_sql() -> str:
    options = Search()
    tokens = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    width = options.window
    return f"""
    WITH d AS (SELECT doc_id, {tokens} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {tokens} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item, w[i:i + {width - 1}] AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    lens AS (SELECT DISTINCT len(win) AS n FROM bw),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
    hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw ON dw.win = array_to_string(bw.win, ' ')),
    hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id),
    dt AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d),
    f AS (SELECT term, count(*) AS n FROM dt GROUP BY term),
    wins AS (SELECT win, row_number() OVER () AS wid FROM (SELECT DISTINCT win FROM bw)),
    wt AS (SELECT wid, len(win) AS size, unnest(win) AS term, generate_subscripts(win, 1) AS k FROM wins),
    ranked AS (SELECT wid, size, term, k, row_number() OVER (PARTITION BY wid ORDER BY n, k) AS r FROM wt JOIN f USING (term)),
    anchors AS (SELECT *, max(r) OVER (PARTITION BY wid) AS most FROM ranked WHERE r <= {options.near_terms}),
    starts AS (SELECT a.wid, dt.doc_id, dt.p - a.k AS s FROM anchors a JOIN dt USING (term) WHERE a.r = 1 AND a.most = least({options.near_terms}, a.size)),
    met AS (SELECT s.wid, s.doc_id, s.s FROM starts s JOIN anchors a ON a.wid = s.wid JOIN dt ON dt.doc_id = s.doc_id AND dt.term = a.term
        AND abs(dt.p - a.k - s.s) <= (CASE WHEN a.r = 1 THEN 0 ELSE {options.slop} END) GROUP BY s.wid, s.doc_id, s.s, a.most HAVING count(DISTINCT a.r) = a.most),
    near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM met JOIN wins USING (wid) JOIN bw USING (win) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_near, 0) AS n_near_items
    FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN near USING (doc_id)
    """


def mix_sql() -> str:
    o = Mix()
    weight = " ".join(f"WHEN {k} THEN {w}.0" for k, w in enumerate(o.weights))
    name = "coalesce('s' || source, 'n')"
    levels, level, widest = [], 0, o.shards
    while widest > 1:
        before = "tokens" if level == 0 else f"t{level - 1}"
        levels.append(f"""
    r{level} AS (SELECT *, CAST(floor((low + high + 1) / 2) AS INT) AS middle, count(*) OVER (PARTITION BY low, high) AS n,
        row_number() OVER (PARTITION BY low, high ORDER BY md5('{o.seed}|tree|{level}|' || {name} || '|' || block || '|' || draw)) AS k FROM {before}),
    t{level} AS (SELECT source, block, draw, CASE WHEN k <= floor(n * (middle - low) / (high - low)) THEN low ELSE middle END AS low,
        CASE WHEN k <= floor(n * (middle - low) / (high - low)) THEN middle ELSE high END AS high FROM r{level}),""")
        level, widest = level + 1, (widest + 1) // 2
    return rf"""
    WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('{o.seed}|part|' || coalesce('i' || doc_id, 'n')) AS draw_order,
        CAST('0x' || substr(md5('{o.seed}|block|' || coalesce('i' || doc_id, 'n')), 1, 8) AS BIGINT) % {o.blocks} AS block FROM documents),
    blocks AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source, block),
    sizes AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM blocks GROUP BY source),
    weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(o.weights)} {weight} END AS weight, CAST({o.most} * source_size AS DOUBLE) AS most FROM sizes),
    spread AS (SELECT *, most / weight AS stop, coalesce(sum(most) OVER prior, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER prior, 0) AS rest,
        {o.share}::DOUBLE * sum(source_size) OVER () AS words FROM weighed WINDOW prior AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    water AS (SELECT (words - filled) / rest AS water FROM spread WHERE (words - filled) / rest <= stop ORDER BY stop, 1 LIMIT 1),
    targets AS (SELECT source, source_size, coalesce(least(most, (SELECT water FROM water) * weight), most) AS target FROM spread),
    q AS (SELECT b.source, b.block, b.words, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS passes,
        coalesce(sum(b.words) OVER (PARTITION BY b.source ORDER BY md5('{o.seed}|order|' || coalesce('s' || b.source, 'n') || '|' || b.block), b.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM blocks b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
    quotas AS (SELECT *, greatest(0.0::DOUBLE, least(target - passes * source_size - before, words::DOUBLE)) AS part FROM q),
    tokens AS (SELECT source, block, unnest(range(1, CAST(passes AS INT) + (CASE WHEN part > 0 THEN 1 ELSE 0 END) + 1)) AS draw, 0 AS low, {o.shards} AS high FROM quotas),
    {"".join(levels)}
    placed AS (SELECT s.*, q.source_size, q.target, q.passes, q.part, q.words, floor(q.part) AS drawn, sum(s.size) OVER (PARTITION BY s.source, s.block, draw_order) AS alike,
        sum(s.size) OVER (PARTITION BY s.source, s.block ORDER BY draw_order RANGE UNBOUNDED PRECEDING) AS upto
        FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source AND s.block = q.block),
    extras AS (SELECT *, CAST(CASE WHEN part <= 0 THEN 0 WHEN part >= words OR upto <= drawn THEN size WHEN upto - alike >= drawn THEN 0 ELSE size * (drawn - upto + alike) // alike END AS BIGINT) AS extra FROM placed),
    shards AS (SELECT source, block, list(CAST(low AS VARCHAR) ORDER BY draw) AS shards FROM t{level - 1} GROUP BY source, block)
    SELECT e.doc_id, e.size, e.source_size, round(e.target, 4) AS target, CAST(e.passes * e.size + e.extra AS BIGINT) AS taken,
        coalesce(array_to_string(h.shards[1:CAST(e.passes + (CASE WHEN e.extra > 0 THEN 1 ELSE 0 END) AS BIGINT)], ','), '') AS shards
    FROM extras e LEFT JOIN shards h ON e.source IS NOT DISTINCT FROM h.source AND e.block = h.block
    """


def url_sql(sites: tuple[str, ...]) -> str:
    rules = sorted(url_cascade.RULES, key=lambda r: -len(r[1] + r[2]))

    def case(value: int) -> str:
        fits = (f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{(r[0], r[1] + r[2])[value]}'" for r in rules)
        return f"CASE {' '.join(fits)} END"

    return rf"""
    WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
    SELECT page_id, host, path, {case(1)} AS rule,
        coalesce({case(0)}, CASE WHEN list_has_any(string_split(host, '.'), [{", ".join(map(quoted, sites))}]) THEN 'block' ELSE 'allow' END) AS verdict FROM p
    """


def negatives_sql() -> str:
    return """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS other_id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
        FROM e a JOIN e x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS INT) AS rank,
        s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) <= 3
    """


def runs_sql() -> str:
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    step = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))"
    return rf"""
    WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), {step}), 4294967295) AS h FROM documents),
    g AS (SELECT doc_id, w, h, len(w) AS n, h // 10 AS g FROM t),
    a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
    p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
    d AS (SELECT doc_id, unnest(range(n)) AS i, w, a, p FROM p),
    words AS (SELECT doc_id, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM d),
    pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
    islands AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
    runs AS (SELECT doc_id, s, e, min(q) AS q FROM islands GROUP BY doc_id, s, e),
    per_doc AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, l := e - s, q := q), struct_pack(l := s - e, s := s, q := q)) AS top,
        string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
    dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
    SELECT g.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, CAST(top.q AS BIGINT) AS period, CAST(1000 * top.l // top.q AS BIGINT) AS exponent_milli,
        sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
    FROM g LEFT JOIN per_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
    """
