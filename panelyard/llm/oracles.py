"""DuckDB SQL that checks the queries which SQL can express."""

from __future__ import annotations

import zlib

from panelyard.llm import lines, mixing, sharding, vector_codes


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, byte by byte."""
    entry = [0] * 256  # entry 255 - i of the polynomial's table follows from the checksum of the byte i
    for i in range(256):
        entry[255 - i] = zlib.crc32(bytes([i])) ^ 0xFF000000
    table = "[" + ",".join(map(str, entry)) + "]::BIGINT[]"
    units = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    folded = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {units}), lambda c, b: xor(c >> 8, ({table})[(xor(c, b) & 255) + 1]))"
    return f"xor({folded}, CAST(4294967295 AS BIGINT))"


def draw_sql(key: str, level: str, node: int, weight: float) -> str:
    return f"(-ln((CAST(CAST('0x' || substr(md5('{level}{node}:' || {key}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / {float(weight)})"


def choice_sql(key: str, level: str, nodes: dict[int, float]) -> str:
    if len(nodes) == 1:
        return str(next(iter(nodes)))
    draws = ", ".join(f"{{'d': {draw_sql(key, level, n, w)}, 'node': {n}}}" for n, w in sorted(nodes.items()))
    return f"list_aggregate([{draws}], 'min').node"


def descent_sql(prefix: str, shards: int) -> list[str]:
    """Three select lists: region, rack and shard of the standard tree."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    leaves: dict[int, dict[int, float]] = {}
    for leaf in sharding.standard_tree(shards):
        regions[leaf.region] = regions.get(leaf.region, 0) + leaf.weight
        inner = racks.setdefault(leaf.region, {})
        inner[leaf.rack] = inner.get(leaf.rack, 0) + leaf.weight
        leaves.setdefault(leaf.rack, {})[leaf.shard] = leaf.weight

    def cases(column: str, level: str, children: dict[int, dict[int, float]]) -> str:
        return "CASE " + column + " " + " ".join(f"WHEN {p} THEN {choice_sql('key', level, n)}" for p, n in children.items()) + " END"

    return [f"{choice_sql('key', 'region', regions)} AS {prefix}region", f"{cases(prefix + 'region', 'rack', racks)} AS {prefix}rack",
            f"{cases(prefix + 'rack', 'shard', leaves)} AS {prefix}shard"]


def sharding_sql(shards: int = sharding.BASE_SHARDS) -> str:
    now, grown = descent_sql("", shards), descent_sql("grown_", shards + 1)
    return f"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents
), a AS (
  SELECT doc_id, key, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, {crc32_sql('t')} AS text_crc32, substr(md5(key), 1, 3) AS bucket FROM d
), r AS (SELECT *, {now[0]}, {grown[0]} FROM a
), k AS (SELECT *, {now[1]}, {grown[1]} FROM r
), s AS (SELECT *, {now[2]}, {grown[2]} FROM k)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS BIGINT) AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard, CAST(region AS INTEGER) AS region, CAST(rack AS INTEGER) AS rack
FROM s"""


def lines_sql(least: int = lines.LEAST) -> str:
    """Line deduplication by comparing every two distinct lines of a length within one that share a half."""
    return f"""WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents
), o AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM d
), w AS (
  SELECT * FROM o WHERE trim(regexp_replace(line, '[\\x09-\\x0D]', ' ', 'g')) <> ''
), f AS (
  SELECT line, min({{'d': doc_id, 'p': pos}}) AS first, length(line) AS n FROM w GROUP BY line
), l AS (
  SELECT *, unnest([n, n + 1]) AS m FROM f WHERE n >= {least}
), h AS (
  SELECT line, first, n, m, 0 AS side, left(line, CAST((m - 1) // 2 AS BIGINT)) AS half FROM l
  UNION ALL SELECT line, first, n, m, 1, right(line, CAST(m - 1 - (m - 1) // 2 AS BIGINT)) FROM l
), c AS (
  SELECT DISTINCT a.line AS line, b.line AS other, a.n AS n, b.n AS k FROM h a JOIN h b USING (m, side, half)
  WHERE b.first < a.first AND abs(a.n - b.n) <= 1
), e AS (
  SELECT *, len(list_filter(range(1, least(n, k) + 1), lambda i: left(line, i) = left(other, i))) AS p,
    len(list_filter(range(1, least(n, k) + 1), lambda i: right(line, i) = right(other, i))) AS s FROM c
), near AS (
  SELECT DISTINCT line FROM e WHERE p + s >= greatest(n, k) - 1
), g AS (
  SELECT w.doc_id, w.pos, near.line IS NOT NULL AS near, (w.doc_id = f.first.d AND w.pos = f.first.p) AS head
  FROM w JOIN f USING (line) LEFT JOIN near USING (line)
), x AS (
  SELECT doc_id, list(pos) FILTER (near OR NOT head) AS gone, count(*) FILTER (near AND head) AS n_near FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
  md5(coalesce(array_to_string(list_transform(list_filter(range(len(parts)), lambda i: NOT list_contains(coalesce(gone, []), i)),
    lambda i: parts[i + 1]), chr(10)), '')) AS kept_md5
FROM d LEFT JOIN x USING (doc_id)"""


def repeats_sql(window: int = 200) -> str:
    """Removal of repeated byte strings, window by window.  Ids must be distinct."""
    return f"""WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, s, md5(t[s + 1:s + {window}]) AS g FROM (SELECT doc_id, t, unnest(range(0, n - {window - 1})) AS s FROM d)
), r AS (
  SELECT doc_id, s FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)
), i AS (
  SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {window} THEN 1 ELSE 0 END AS fresh FROM r
), j AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i
), runs AS (
  SELECT doc_id, min(s) AS a, max(s) + {window} AS b FROM j GROUP BY doc_id, run
), cut AS (
  SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, CAST(sum(b - a) AS BIGINT) AS gone FROM runs GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, n, coalesce(gone, 0) AS gone, CAST(coalesce(len(a), 0) AS BIGINT) AS spans,
    CASE WHEN a IS NULL THEN t ELSE unhex(array_to_string(list_transform(range(len(a) + 1),
      lambda i: hex(t[coalesce(b[i], 0) + 1:coalesce(a[i + 1], n)])), '')) END AS rest
  FROM d LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n AS n_bytes, CAST(gone AS BIGINT) AS n_removed, spans AS n_spans, sha256(rest) AS kept_sha256 FROM kept"""


def jaccard_sql(shingle: int = 4, percent: int = 85) -> str:
    """Components of documents by exact Jaccard similarity, pairs from the shared shingles.  Ids must be distinct."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE v AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {shingle} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {shingle - 2}), lambda i: array_to_string(words[i:i + {shingle - 1}], ' '))) END AS g FROM v
), u AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS both_have
  FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c WHERE 100 * both_have >= {percent} * (m + n - both_have)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), least_of AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN least_of ON a = doc_id"""


def due_sql(demand: str, course: mixing.Course) -> str:
    """Time at which a share of a source's words is asked for, piece by piece of the course."""
    cases = []
    pieces = course.pieces()
    for i, (begin, end, factor, slope, before) in enumerate(pieces):
        rest = f"({demand} - {before!r}::DOUBLE)"
        root = f"({factor!r}::DOUBLE + sqrt(greatest({factor * factor!r}::DOUBLE + ({2 * slope!r})::DOUBLE * {rest}, 0::DOUBLE)))"
        time = f"least({float(begin)!r}::DOUBLE + CASE WHEN {root} > 0 THEN 2::DOUBLE * {rest} / {root} ELSE 0 END, {float(end)!r}::DOUBLE)"
        cases.append(f"WHEN {demand} < {pieces[i + 1][4]!r}::DOUBLE THEN {time}" if i + 1 < len(pieces) else f"ELSE {time}")
    return f"CASE {' '.join(cases)} END" if len(cases) > 1 else cases[0].removeprefix("ELSE ")


def mixing_sql() -> str:
    """The mix by one window over each source; the level is the one at which the first source in order of fullness is not full."""
    share, passes, courses = mixing.SHARE_PERCENT, mixing.MOST_PASSES, mixing.COURSES
    weights = ", ".join(str(c.weight) for c in courses)
    times = "CASE kind " + " ".join(f"WHEN {i} THEN {due_sql('{share}', c)}" for i, c in enumerate(courses)) + " END"
    upto = [f"CASE WHEN words{p} > 0 THEN {times.replace('{share}', f'(CAST(b + {p} * source_size AS DOUBLE) / target)')} END AS due{p}" for p in range(passes)]
    words = [f"CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - b - {p} * source_size)) AS BIGINT) AS words{p}" for p in range(passes)]
    return f"""WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source
), w AS (
  SELECT *, turn % {len(courses)} AS kind, ([{weights}])[turn % {len(courses)} + 1] AS weight FROM s
), c AS (
  SELECT *, sum(source_size) OVER () AS whole, source_size::DOUBLE / weight AS fullness,
    coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_words,
    sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w
), l AS (
  SELECT min_by(level, fullness) AS level FROM (
    SELECT *, CAST({share} * whole - {100 * passes} * full_words AS DOUBLE) / CAST(100 * open_weight AS DOUBLE) AS level FROM c)
  WHERE {passes} * source_size > level * weight
), f AS (
  SELECT source, source_size, kind, least(CAST(source_size AS DOUBLE) * {passes}, weight * coalesce(level, 1e300)) AS target FROM c, l
), r AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.kind,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
), q AS (
  SELECT *, {', '.join(words)} FROM r
), u AS (
  SELECT *, {', '.join(upto)} FROM q
)
SELECT doc_id, size, source_size, target, {' + '.join(f'words{p}' for p in range(passes))} AS taken,
  coalesce({', '.join(f'due{p}' for p in range(passes))}) AS first_due, coalesce({', '.join(f'due{p}' for p in reversed(range(passes)))}) AS last_due FROM u"""


def vector_codes_sql() -> str:
    """Codes by measuring every distinct part against every entry; the length must be a multiple of the parts, and the same in all rows."""
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS

    def nearest(round_: int) -> str:
        return f"""n{round_} AS (
  SELECT u.p, u.part, min({{'d': CAST(list_sum(list_transform(range(1, len(u.part) + 1), lambda i: (u.part[i] - b.part[i]) * (u.part[i] - b.part[i]))) AS BIGINT),
    'k': b.k}}) AS best FROM (SELECT DISTINCT p, part FROM v) u JOIN b{round_} b USING (p) GROUP BY u.p, u.part)"""

    def moved(round_: int) -> str:
        return f"""x{round_} AS (
  SELECT v.p, best.k AS k, count(*) AS n, list(v.part) AS own FROM v JOIN n{round_} USING (p, part) GROUP BY v.p, best.k
), b{round_ + 1} AS (
  SELECT b.p, b.k, CASE WHEN x.n IS NULL THEN b.part ELSE list_transform(range(1, len(b.part) + 1),
    lambda i: CAST(floor(CAST(list_sum(list_transform(x.own, lambda o: o[i])) AS DOUBLE) / x.n) AS BIGINT)) END AS part
  FROM b{round_} b LEFT JOIN x{round_} x USING (p, k))"""

    steps = ",\n".join(f"{nearest(r)}, {moved(r)}" for r in range(rounds))
    return f"""WITH e AS (
  SELECT vec_id, label, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT rid, vec_id, p, vec[p * (len(vec) // {parts}) + 1:(p + 1) * (len(vec) // {parts})] AS part FROM e, (SELECT unnest(range({parts})) AS p)
), b0 AS (
  SELECT p, k, part FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM v) WHERE k < {entries}
), {steps}, {nearest(rounds)}, h AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds}
), c AS (
  SELECT rid, string_agg(lower(format('{{:02x}}', best.k)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM v JOIN n{rounds} USING (p, part) GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN c USING (rid), h"""


def repair_sql() -> str:
    """Conversation repair by a forward table over rows and role states that carries each state's least cost, edits and text."""
    def least(*cases: str) -> str:
        return f"list_aggregate([{', '.join(cases)}], 'min')"

    def then(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}}"

    def delete(state: str) -> str:
        return then(state, "4", "D")

    def keep(state: str, initial: str) -> str:
        return then(state, f"CASE WHEN initial = '{initial}' AND fault < 2 THEN 3 * fault ELSE 1000000 END", "K", "chr(10) || role || ':' || text")

    def rerole(state: str, role: str) -> str:
        return then(state, "CASE WHEN fault < 2 THEN 3 + 3 * fault ELSE 1000000 END", "R", f"chr(10) || '{role}:' || text")

    def insert(state: str, role: str) -> str:
        return then(state, "3", "I", f"chr(10) || '{role}:'")

    word = "[^\\x20\\x09-\\x0D]"
    return f"""WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations
), e AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE fate <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM e
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{word}') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 1 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o
), n AS (
  SELECT conv_id AS c_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank,
    count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
), z AS (
  SELECT *, {insert('s2', 'assistant')} AS s3 FROM (SELECT *, {insert('s0', 'user')} AS s2 FROM (
    SELECT DISTINCT conv_id AS id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS s0, {{'c': CAST(900000 AS BIGINT), 'a': '', 'r': ''}} AS s1
    FROM conversations))
), t AS (
  SELECT id, pos, s0, s1, s2, s3 FROM z
  UNION ALL
  SELECT id, pos, n0 AS s0, n1 AS s1, m2 AS s2, {least('n3', insert('m2', 'assistant'))} AS s3 FROM (
    SELECT *, {least('n2', insert('n0', 'user'), insert('n1', 'user'), insert('n3', 'user'))} AS m2 FROM (
      SELECT id, pos + 1 AS pos, {delete('s0')} AS n0, {least(delete('s1'), keep('s0', 's'))} AS n1,
        {least(delete('s2'), *(keep(s, 'u') for s in ('s0', 's1', 's3')), *(rerole(s, 'user') for s in ('s0', 's1', 's3')))} AS n2,
        {least(delete('s3'), keep('s2', 'a'), rerole('s2', 'assistant'))} AS n3
      FROM t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.id AND f.i = t.pos + 1))
), b AS (
  SELECT id, pos, {least('s0', 's3')} AS best FROM t
)
SELECT id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
FROM b LEFT JOIN n ON id IS NOT DISTINCT FROM c_id WHERE pos = coalesce(n, 0)"""
