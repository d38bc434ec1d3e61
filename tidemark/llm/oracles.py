"""DuckDB SQL of the operators that SQL can express whole, written for itself: it shares nothing with the Spark code but
the contract."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def collocations(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """Every phrase is counted by shifted words of its piece; nothing is pruned before the counts."""
    phrases = " UNION ALL ".join(
        f"SELECT lang, {k} AS size, " + " || ' ' || ".join(f"w{i}" for i in range(k)) + f" AS phrase, count(*) AS f FROM shifted WHERE w{k - 1} IS NOT NULL GROUP BY 1, 3 HAVING count(*) >= {least}" for k in range(1, longest + 1)
    )
    leads = ", ".join(f"lead(word, {i}) OVER w AS w{i}" for i in range(1, longest))
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
), words AS (
  SELECT lang, id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM numbered
), shifted AS (
  SELECT lang, word AS w0, {leads} FROM words WINDOW w AS (PARTITION BY id ORDER BY pos)
), phrases AS ({phrases}),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY 1),
cuts AS (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM phrases WHERE size > 1),
scores AS (
  SELECT c.lang, c.phrase, c.size, c.f AS a, l.f AS l, r.f AS r, n, k, CAST((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM best x WHERE x.lang = b.lang AND x.size > b.size AND x.a >= b.a AND strpos(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') > 0)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM kept QUALIFY rank <= {top}
"""


_CONTROL = ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[AS]"]


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in sorted(_CONTROL, key=len, reverse=True):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


CHAT = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, length({_escaped('text')}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17 ELSE 21 + length({_escaped('role')}) END AS chars FROM every
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM marked GROUP BY 1
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""


def manifest(levels: int = 6, fanout: int = 16) -> str:
    """Levels are written out one by one: enough for fanout^levels leaves a source, and as many sources. A group of one
    node stays as it is."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + field(text) + ")"
    ctes = [f"""
crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
tampered AS (
  SELECT d.*, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 5 = 0
                   THEN translate(text, '{_UP}', '{_LOW}') ELSE text END AS claim
  FROM documents d, crc_table
),
leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('claim')} AS claimed FROM tampered),
c0 AS (
  SELECT doc_id, leaf, claimed AS folded, '' AS proof, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i FROM leaves
),
n0 AS (SELECT g, i, leaf AS hash FROM c0)"""]  # fmt: skip

    def climb(k: int, nodes: str, climbers: str, new_nodes: str, new_climbers: str) -> None:
        ctes.append(f"""
s{k} AS (SELECT g, i, i // {fanout} AS up, hash, count(*) OVER (PARTITION BY g) AS n FROM {nodes}),
u{k} AS (SELECT g, up, any_value(n) AS n, list(hash ORDER BY i) AS run, min(i) AS lo FROM s{k} GROUP BY 1, 2),
{new_nodes} AS (SELECT g, up AS i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS hash FROM u{k}),
{new_climbers} AS (
  SELECT c.* EXCLUDE (folded, proof, i), u.up AS i,
         CASE WHEN n = 1 THEN folded ELSE sha256(array_to_string(run[:c.i - lo], '') || folded || array_to_string(run[c.i - lo + 2:], '')) END AS folded,
         CASE WHEN n = 1 THEN proof ELSE proof || array_to_string(run[:c.i - lo], '') || array_to_string(run[c.i - lo + 2:], '') END AS proof
  FROM {climbers} c JOIN u{k} u ON u.g = c.g AND u.up = c.i // {fanout}
)""")  # fmt: skip

    for k in range(levels):
        climb(k, f"n{k}", f"c{k}", f"n{k + 1}", f"c{k + 1}")
    ctes.append(f"""
m0 AS (SELECT 0 AS g, g AS i, hash FROM n{levels}),
d0 AS (SELECT c.doc_id, c.leaf, n.hash AS subroot, c.folded, c.proof, 0 AS g, c.g AS i FROM c{levels} c JOIN n{levels} n ON n.g = c.g)""")
    for k in range(levels):
        climb(levels + k, f"m{k}", f"d{k}", f"m{k + 1}", f"d{k + 1}")
    return "WITH " + ",".join(ctes) + f"""
SELECT doc_id, leaf, subroot, m.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m.hash AS verified FROM d{levels} d JOIN m{levels} m ON m.g = d.g
"""  # fmt: skip
