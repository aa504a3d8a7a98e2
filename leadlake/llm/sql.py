"""SQL that gives the rows of the registered corpus queries, where SQL can express them."""

from __future__ import annotations


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _climb(name: str, level: int) -> list[str]:
    """Two tables of a tree: siblings of each node of a level, and the level above."""
    now = f"{name}{level}"
    return [
        f"""{name}_run{level} AS (SELECT *, i // 16 AS up, count(*) OVER (PARTITION BY tree) AS n,
  coalesce(string_agg(digest, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(digest, '') OVER (PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM {now})""",
        f"""{name}{level + 1} AS (SELECT tree, up AS i,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE any_value(digest) END AS digest
  FROM {name}_run{level} GROUP BY tree, up)""",
    ]


def manifest_sql(levels: int = 6) -> str:
    """Trees of at most 16 ** ``levels`` leaves."""
    leaf = "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    changed = "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || CASE WHEN text IS NULL THEN '-' ELSE " + _field(_lower("text")) + " END)"
    parts = [
        # CRC-32 has no function here: the digits of a key, bit by bit
        """keys AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)""",
        """crc(doc_id, digits, k, c) AS (SELECT doc_id, CAST(doc_id AS VARCHAR), 0, 4294967295::BIGINT FROM keys
  UNION ALL SELECT doc_id, digits, k + 1, CASE WHEN c1 & 1 = 1 THEN xor(c1 >> 1, 3988292384::BIGINT) ELSE c1 >> 1 END
  FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, CAST(unicode(substr(digits, k // 8 + 1, 1)) AS BIGINT)) ELSE c END AS c1
        FROM crc WHERE k < 8 * length(digits)))""",
        "hit AS (SELECT doc_id AS hit_id FROM crc WHERE k = 8 * length(digits) AND xor(c, 4294967295::BIGINT) % 5 = 0)",
        f"""t0 AS (SELECT coalesce('s' || source, '') AS tree, doc_id, {leaf} AS digest,
  CASE WHEN hit_id IS NOT NULL THEN {changed} END AS changed,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf}) - 1 AS i
  FROM documents LEFT JOIN hit ON doc_id = hit_id)""",
    ]
    for k in range(levels):
        parts += _climb("t", k)
    parts.append(f"s0 AS (SELECT '' AS tree, tree AS grp, row_number() OVER (ORDER BY tree) - 1 AS i, digest FROM t{levels})")
    for k in range(levels):
        parts += _climb("s", k)
    steps, joins = [], []
    for name, key in (("t", "t0.tree"), ("s", "''")):
        start = "t0.i" if name == "t" else "s0.i"
        for k in range(levels):
            r = f"{name}r{k}"
            joins.append(f"JOIN {name}_run{k} {r} ON {r}.tree = {key} AND {r}.i = {start} // {16**k}")
            steps.append(r)
        if name == "t":
            joins.append("JOIN s0 ON s0.grp = t0.tree")
    proof = " || ".join(f"CASE WHEN {r}.n > 1 THEN {r}.b || {r}.a ELSE '' END" for r in steps)
    fold = []
    parts.append(
        "path AS (SELECT t0.doc_id, t0.digest AS leaf, coalesce(t0.changed, t0.digest) AS f0, s0.digest AS subroot, "
        f"sha256({proof}) AS proof_sha256, " + ", ".join(f"{r}.n AS n_{r}, {r}.b AS b_{r}, {r}.a AS a_{r}" for r in steps)
        + " FROM t0 " + " ".join(joins) + ")"
    )
    for j, r in enumerate(steps):
        source = "path" if j == 0 else f"fold{j}"
        fold.append(f"fold{j + 1} AS (SELECT *, CASE WHEN n_{r} > 1 THEN sha256(b_{r} || f{j} || a_{r}) ELSE f{j} END AS f{j + 1} FROM {source})")
    end = f"f{len(steps)}"
    return (
        "WITH RECURSIVE " + ",\n".join(parts + fold)
        + f"\nSELECT doc_id, leaf, subroot, s{levels}.digest AS root, proof_sha256, {end} AS folded_root, {end} = s{levels}.digest AS verified FROM fold{len(steps)}, s{levels}"
    )


def decontamination_sql(window: int = 10) -> str:
    words = f"regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    def windows(table: str) -> str:
        size = f"least(len(w), {window})"
        if table == "docs":  # every length that a window can have
            return f"SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM docs, lengths, unnest(range(1, len(w) - k + 2)) AS u(i)"
        return f"SELECT item_id, {size} AS k, array_to_string(w[i:i + {size} - 1], ' ') AS phrase FROM items, unnest(range(1, len(w) - {size} + 2)) AS u(i) WHERE len(w) > 0"

    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
wanted AS (SELECT DISTINCT * FROM ({windows('items')})),
lengths AS (SELECT DISTINCT k FROM wanted),
places AS (SELECT d.rid, d.i, d.k, t.item_id FROM ({windows('docs')}) d JOIN wanted t ON d.k = t.k AND d.phrase = t.phrase),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM places, unnest(range(i, i + k)) AS u(p) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM places) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)"""


def collocation_sql(least: int = 100, cover: int = 100, most: int = 2000, longest: int = 5) -> str:
    pieces = f"string_split_regex({_lower('text')}, '[.,;:!?\\x0A-\\x0D]')"
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM documents, unnest({pieces}) AS u(p)),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM pieces, range(1, {longest + 1}) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
several AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT s.lang, s.phrase, s.f AS a, l.f AS l, r.f AS r, t.n, c, (1000 * s.f::HUGEINT * t.n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM several s, unnest(range(1, s.k)) AS u(c), f l, f r, total t
  WHERE l.lang = s.lang AND r.lang = s.lang AND t.lang = s.lang
    AND l.phrase = array_to_string(s.w[:c], ' ') AND r.phrase = array_to_string(s.w[c + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ones AS (SELECT DISTINCT s.lang, array_to_string(s.w[i:i + z - 1], ' ') AS phrase, s.f FROM several s, unnest(range(2, s.k)) AS u(z), unnest(range(1, s.k - z + 2)) AS v(i)),
kept AS (SELECT * FROM scored c WHERE NOT EXISTS (SELECT 1 FROM inner_ones o WHERE o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.f >= {cover} * c.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {most}"""


def top_k_sql(k: int = 10, scale: int = 1024, every: int = 100) -> str:
    """Equal query rows are one query; products of doubles are exact here, as they are whole numbers below 2 ** 53."""
    return f"""WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT DISTINCT * FROM fine WHERE vec_id % {every} = 0),
met AS (SELECT q.vec_id AS query_id, q.w AS asked, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM asked q JOIN fine c ON c.vec_id <> q.vec_id AND len(c.w) = len(q.w))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM met QUALIFY rank <= {k}"""
