"""The text operators' queries and SQL, by name."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rackwise.llm.bpe import op5_bpe
from rackwise.llm.chat_format import op11_chat
from rackwise.llm.collocations import op13_collocations
from rackwise.llm.conversation_trie import op12_prefix_trie
from rackwise.llm.decontaminate import op7_decontaminate
from rackwise.llm.html_text import op2_html
from rackwise.llm.katz import op4_katz
from rackwise.llm.quality import op3_quality
from rackwise.llm.simhash import op8_simhash
from rackwise.llm.substring import op9_substring
from rackwise.llm.token_counts import op1_token_counts
from rackwise.llm.token_files import op10_token_files
from rackwise.llm.toxicity import op6_toxicity

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once an application, in case their Python path doesn't have it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = pathlib.Path(__file__).resolve().parents[1]
    file = f"{tempfile.mkdtemp(prefix='rackwise-')}/rackwise.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(file)


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_html, op3_quality, op4_katz, op5_bpe, op6_toxicity, op7_decontaminate, op8_simhash, op9_substring, op10_token_files, op11_chat, op12_prefix_trie, op13_collocations]
    return {q.__name__: _shipping(q) for q in found}


#: Windows of 35 words as text, counted over the whole table; words are put together again without those that repeated windows cover.
SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 33))) AS i FROM d)),
again AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: Words of pieces as rows, phrases by lag; whole numbers of 128 bits.
COLLOCATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT r, lang, unnest(p) AS piece, unnest(range(len(p))) AS q FROM d),
s AS (SELECT r, lang, q, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
w AS (SELECT r, lang, q, unnest(w) AS w, unnest(range(len(w))) AS i FROM s),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4, lead(w, 4) OVER x AS w5 FROM w WINDOW x AS (PARTITION BY r, q ORDER BY i)),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, [w1] AS p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
longer AS (SELECT DISTINCT lang, p[a:b] AS p, f FROM f, (SELECT a, b FROM range(1, 6) x(a), range(1, 6) y(b)) WHERE b > a AND b <= len(p) AND b - a + 1 < len(p)),
c AS (SELECT * FROM f WHERE len(p) > 1 AND NOT EXISTS (SELECT 1 FROM longer l WHERE l.lang = f.lang AND l.p = f.p AND l.f >= f.f)),
cuts AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM c),
scored AS (SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, n, CAST((CAST(1000 AS HUGEINT) * c.f * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.p[:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:] JOIN n ON n.lang = c.lang),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS BIGINT) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM one QUALIFY rank <= 2000
"""

#: Digests straight from the table; the length of the template from the texts with their escapes.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, '{"kind":"text","text":' || to_json(text) || '}' AS j, length(regexp_replace(replace(role, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) + length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) + 23 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id
"""

#: Paths by running lists of digests; crc32 bit by bit; subtrees by pairs of a node and a node below it.
TRIE_SQL = r"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text)) AS i FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS b, xor(4294967295, list_reduce(list_transform(range(length(CAST(conv_id AS VARCHAR)) + 1), lambda k: CASE WHEN k = 0 THEN 4294967295 ELSE CAST(ord(substr(CAST(conv_id AS VARCHAR), k, 1)) AS BIGINT) END),
  lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c, 1 AS part, i, role, text FROM c JOIN t ON conv_id = b AND i <= h UNION ALL SELECT c, 2, i, role, text FROM c JOIN t ON conv_id = c AND i > h),
o AS (SELECT c, row_number() OVER w AS d, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words, list(sha256(length(role) || ':' || role || ':' || text)) OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY part, i)),
p AS (SELECT c, 0 AS d, '' AS key, NULL AS parent, 0 AS words FROM c UNION ALL SELECT c, d, array_to_string(path, ''), array_to_string(path[:d - 1], ''), words FROM o),
n AS (SELECT key, min(c) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(words) AS own FROM p GROUP BY key),
k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
b AS (SELECT DISTINCT a.key AS key, z.key AS below FROM p a JOIN p z ON a.c = z.c AND z.d >= a.d),
s AS (SELECT b.key, count(*) FILTER (k.key IS NULL) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM b JOIN n ON n.key = b.below LEFT JOIN k ON k.key = b.below GROUP BY b.key),
e AS (SELECT key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY c) USING (c, d) GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n LEFT JOIN n m ON m.key = n.parent LEFT JOIN k ON k.key = n.key JOIN s ON s.key = n.key LEFT JOIN e ON e.key = n.key
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_substring": SUBSTRING_SQL, "op11_chat": CHAT_SQL, "op12_prefix_trie": TRIE_SQL, "op13_collocations": COLLOCATION_SQL}
